"""Jaccard join, licenses and WARC records against plain Python."""

import random
import re
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest
from oracle import DATA
from pyspark.sql import functions as F
from samples import BASE, documents, texts, words

from paneloom.llm import jaccard, licenses, warc

# Jaccard join


def grams(text, n=5):
    w = words(text)
    size = min(n, len(w))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if w else frozenset()


def classes(rows, threshold=0.8):
    """Counter of (id, class_id, copy_of, n_copies, n_links)."""
    holders = defaultdict(list)
    for i, t in rows:
        holders[grams(t)].append(i)
    sets = list(holders)
    links = defaultdict(set)
    for x in range(len(sets)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and both >= threshold * len(sets[x] | sets[y]) - 1e-9:
                links[x].add(y)
                links[y].add(x)

    def least(ids):
        return min((i for i in ids if i is not None), default=None)

    out = Counter()
    for x, s in enumerate(sets):
        reached, todo = {x}, [x]
        while todo:
            todo += (new := links[todo.pop()] - reached)
            reached |= new
        everyone = [i for y in reached for i in holders[sets[y]]]
        for i in holders[s]:
            out[i, least(everyone), least(holders[s]), len(holders[s]), len(links[x])] += 1
    return out


def near_copies(groups=6, members=25):
    rng = random.Random(8)
    rows, number = [], 5000
    for g in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(150)]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = f"new{rng.randint(0, 9999)}"
            rows.append((number, " ".join(own)))
            number += 1
    return rows + [(number, rows[0][1]), (number + 1, rows[0][1])]


@pytest.mark.parametrize("few, block", [(32, 1500), (3, 1500), (3, 7)])
def test_every_link_is_found(spark, few, block):
    rows = texts() + near_copies()
    got = jaccard.near_duplicates(documents(spark, rows), few=few, block_docs=block).collect()
    assert Counter(
        (r.id, r.class_id, r.copy_of, r.n_copies, r.n_links) for r in got
    ) == classes(rows)


def test_one_document_of_each_class_stays(spark):
    rows = texts() + near_copies(2, 8)
    docs = documents(spark, rows)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = jaccard.near_duplicates(docs).select("label").distinct().count()
    rows = kept.collect()
    assert len(rows) == groups
    ids = {r.doc_id for r in rows}
    assert 11 in ids and not ids & {12, 13, 14}
    assert jaccard.one_of_each(documents(spark, [])).count() == 0


def test_bands_reach_the_recall():
    bands, rows = jaccard.choose_bands(0.8, 0.99999)
    assert bands * rows <= jaccard.MAX_HASHES
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99999
    with pytest.raises(ValueError):
        jaccard.choose_bands(0.1, 0.99999, 8)


# licenses


def spans(text):
    """Kept detections by plain regular expressions, as (label, start, end, base)."""
    padded = " " + " ".join(words(text)) + " "
    found = []
    for order, rule in enumerate(licenses.rules()):
        for m in re.finditer(f"(?<= )(?:{rule.pattern})(?= )", padded):
            start = padded[: m.start()].count(" ") - 1
            found.append((start, -(start + m[0].count(" ") + 1), rule.rank, order, rule))
    found.sort(key=lambda f: f[:4])
    kept = []
    for at, (start, back, rank, _, rule) in enumerate(found):
        inside = any(o[1] <= back and o[2] <= rank and not o[4].base for o in found[:at])
        if rule.base or not inside:
            kept.append((rule.label, start, -back, rule.base))
    return Counter(kept)


NOTICES = [
    (700, "This work is licensed under the GNU General Public License, version 3. End"),
    (701, "Licensed under CC BY-NC 4.0. SPDX-License-Identifier: MIT-0 / Apache-2.0"),
    (702, "SPDX-License-Identifier: GPL-2.0-or-later; All rights reserved; BSD 3-clause license"),
    (703, "mit license " * 300 + "Permission is hereby granted, free of charge, to any person"
          " obtaining a copy of this software and associated documentation files"),
    (704, "apache lıcense Apache\tLICENSE; http://www.apache.org/licenses/LICENSE-2.0.txt"),
    (705, "committee apache licenses cc bye permit license"),
]


def test_detections(spark):
    rows = texts() + NOTICES
    got = licenses.scan(documents(spark, rows)).collect()
    assert Counter((r.row.doc_id, r.n_words) for r in got) == Counter(
        (i, len(words(t))) for i, t in rows
    )
    found = defaultdict(Counter)
    for r in got:
        found[r.row.doc_id] += Counter((d.label, d.start, d.end, d.base) for d in r.detections)
    for i, t in rows:
        if i is not None:
            times = sum(1 for j, _ in rows if j == i)
            assert found[i] == Counter({k: n * times for k, n in spans(t).items()}), i
    assert licenses.scan(documents(spark, [])).count() == 0


def test_rules_number_hundreds_and_pass_their_gates():
    found = licenses.rules()
    assert len(found) > 250
    for rule in found:
        literal = re.sub(r"\(\?:[^()]*\)\?|[()?:\[\]\\]", "", rule.pattern.replace("licen[sc]e", "license"))
        assert rule.label and 0 <= rule.rank < licenses.RANKS and literal
    for label, keyword, name in licenses.NAMES:
        options = re.sub(r"\(\?:(?:[^()]|\([^()]*\))*\)\??", " ", name)
        assert keyword.split()[0] in name, (label, options)


def forms(items):
    """Texts that a parsed pattern matches: the first has all that is optional and every first
    alternative, each of the others differs in one place."""
    out = [""]
    for kind, value in items:
        kind = str(kind)
        if kind == "LITERAL":
            own = [chr(value)]
        elif kind == "IN":
            own = [chr(v if str(k) == "LITERAL" else v[0]) for k, v in value]
        elif kind == "BRANCH":
            own = [f for option in value[1] for f in forms(option)]
        elif kind == "SUBPATTERN":
            own = forms(value[3])
        elif kind == "MAX_REPEAT":
            own = [*forms(value[2]), *([] if value[0] else [""])]
        else:
            raise ValueError(kind)
        out = [out[0] + own[0], *(o + own[0] for o in out[1:]), *(out[0] + o for o in own[1:])]
    return out


def test_every_alternative_of_every_rule_is_found(spark):
    samples = [(rule, f) for rule in licenses.rules() for f in forms(re._parser.parse(rule.pattern))]
    rows = list(enumerate(f for _, f in samples))
    found = {r.row.doc_id: r for r in licenses.scan(documents(spark, rows)).collect()}
    lost = [
        (rule.label, text)
        for i, (rule, text) in enumerate(samples)
        if not any(
            (d.label, d.start, d.end, d.base) == (rule.label, 0, found[i].n_words, rule.base)
            for d in found[i].detections
        )
    ]
    assert not lost


@pytest.mark.parametrize("notice, label", [
    ("FreeBSD license", "bsd-2-clause"), ("SPDX-License-Identifier: MIT", "mit"),
    ("Licensed under the MIT license.", "mit"), ("License: MIT", "mit"),
    ("released under MIT", "mit"), ("GPLv2", "gpl-2.0"), ("GNU GPL", "gpl"),
    ("GPL-3.0 or later", "gpl-3.0-or-later"), ("LGPL-2.1", "lgpl-2.1"), ("MPL 2.0", "mpl-2.0"),
    ("distributed under the terms of the MPL", "mpl"), ("available under Apache 2.0", "apache-2.0"),
    ("SPDX-License-Identifier: MIT-0", "mit-0"), ("released under the BSD license", "bsd"),
    ("GNU Lesser General Public License", "lgpl"),
])
def test_short_notices(spark, notice, label):
    [row] = licenses.scan(documents(spark, [(1, f"x {notice} x")])).collect()
    assert {d.label for d in row.detections if not d.base} == {label}


@pytest.mark.parametrize("text", ["example simple template mplayer", "er kam mit dem Rad",
                                  "the gplus and epl tables", "misc things, acc bye"])
def test_other_words_are_no_notices(spark, text):
    [row] = licenses.scan(documents(spark, [(1, text)])).collect()
    assert row.detections == []


def test_no_python_in_the_plan(spark):
    plan = licenses.scan(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hash" not in plan


# WARC

PAGES = [
    (1, "http://a.example/x", "<html><title>T &amp; U</title><body><p>Hello&nbsp;<b>you</b></p>"
     "<script>var a='<p>';</script><!-- gone --><a href='/l?a=1&amp;b=2'>link</a></body></html>"),
    (2, None, "<p>no url"), (3, "http://b.example/", None), (4, "http://c.example/", ""),
    (5, "http://d.example/", "é\r\n\r\nWARC/1.0 &lt;x&gt; a < b" + "<div>y</div>" * 5000),
    (1, "http://a.example/x", "<p>again"), (None, "http://e.example/", "<td>1<td>2"),
]


def pages(spark, rows=None):
    rows = PAGES if rows is None else rows
    return spark.createDataFrame(
        [(i, u, h, "x", None) for i, u, h in rows],
        "page_id long, url string, html string, page string, block string",
    )


def test_derivatives_are_linked(spark):
    sources = {r.record_id: r for r in warc.responses(pages(spark)).collect()}
    assert len(sources) == len(PAGES)
    derived = warc.derivatives(warc.responses(pages(spark))).collect()
    assert Counter(r.type for r in derived) == {"metadata": len(PAGES), "conversion": len(PAGES)}
    for r in derived:
        source = sources[r.refers_to]
        assert (r.page, r.target_uri, r.date) == (source.page, source.target_uri, source.date)
        assert r.payload_digest == source.payload_digest
        assert r.block_digest == warc.digest(r.block.encode())
        assert f"Content-Length: {len(r.block.encode())}" in r.headers
        if r.type == "conversion":
            twin = next(m for m in derived if m.refers_to == r.refers_to and m.type == "metadata")
            assert f"WARC-Concurrent-To: {twin.record_id}" in r.headers
            assert f"conversion: {r.record_id}" in twin.block
            assert f"payload-digest: {source.payload_digest}" in twin.block
            assert "http-header: Content-Type: text/html; charset=UTF-8" in twin.block
    first = {r.type: r.block for r in derived if r.page == 1 and "Hello" in r.block + "Hello"}
    assert first["metadata"]
    text = warc.plain_text(PAGES[0][2])
    assert text == "Hello you\nlink" or text == "Hello you link"
    assert warc.plain_text(PAGES[4][2]).startswith("é\nWARC/1.0 <x> a < b")


@pytest.mark.parametrize("page, text", [
    ("<h1>a</h1><title-bar>x</title-bar><p>rest of page</p>", "a\nx\nrest of page"),
    ("<script-x>a</script-x><style-x>b</style-x><template-x>c</template-x>"
     "<noscript-x>d</noscript-x><p>e", "abcd\ne"),
    ("a<svg><title/><style/><style media='x>y' /></svg><p>b", "a\nb"),
    ("a<title lang=\"/>\">hidden</title><p>b", "a\nb"),
    ("a<script src='x'/>hidden</script><style\n>hidden</style><TITLE>hidden</title >b", "a b"),
    ("a<p-x>b</p-x>", "ab"),
])
def test_elements_end_at_their_own_names(page, text):
    assert warc.plain_text(page) == text


def test_titles_and_links_are_no_custom_elements(spark):
    page = "<title-bar>x</title-bar><title/><title>T</title><a-b href='/no'></a-b><a href='/l'>"
    derived = warc.derivatives(warc.responses(pages(spark, [(1, None, page)]))).collect()
    [block] = [r.block for r in derived if r.type == "metadata"]
    assert "\r\ntitle: T\r\noutlink: /l\r\n" in block and "/no" not in block


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_files_round_trip(spark, tmp_path, compression):
    records = warc.responses(pages(spark))
    records = records.drop("page").union(warc.derivatives(records).drop("page"))
    warc.write_warc(records, f"{tmp_path}/{compression}", compression)
    back = warc.read_warc(spark, f"{tmp_path}/{compression}")
    assert back.filter(~F.col("complete")).count() == 0
    names = ["record_id", "type", "refers_to", "target_uri", "block_digest", "block"]
    assert Counter(back.select(names).collect()) == Counter(records.select(names).collect())


def test_headers_and_digests_of_the_source_are_kept(spark, tmp_path):
    own = ["WARC-IP-Address: 192.0.2.1", "WARC-Warcinfo-ID: <urn:x>"]
    sources = warc.responses(pages(spark, PAGES[:1])).drop("page").withColumn(
        "headers", F.concat("headers", F.lit("\r\n" + "\r\n".join(own)))
    )
    derived = warc.derivatives(sources)
    [source], records = sources.collect(), derived.collect()
    [block] = [r.block for r in records if r.type == "metadata"]
    assert re.findall(r"(?m)^warc-header: (.*?)\r$", block) == source.headers.split("\r\n")
    warc.write_warc(derived, f"{tmp_path}/out")
    back = warc.read_warc(spark, f"{tmp_path}/out").collect()
    assert [r.payload_digest for r in back] == [source.payload_digest] * 2
    assert not any(re.search("(?m)^WARC-Payload-Digest", r.headers) for r in back)


def test_files_of_the_older_version(spark, tmp_path):
    records = warc.responses(pages(spark)).drop("page")
    for i, r in enumerate(records.collect()):
        text = f"WARC/1.0\r\n{r.headers}{warc.END}{r.block}{warc.END}" * 2
        (tmp_path / f"{i}.warc").write_bytes(text.encode())
    back = warc.read_warc(spark, str(tmp_path), "WARC/1.0")
    assert back.filter(~F.col("complete")).count() == 0
    names = ["record_id", "type", "target_uri", "payload_digest", "block"]
    assert Counter(back.select(names).collect()) == Counter(
        records.union(records).select(names).collect()
    )


def test_no_pages(spark):
    assert warc.derivatives(warc.responses(pages(spark, []))).count() == 0
    assert len(BASE.split()) == 120


class Reader(HTMLParser):
    """Title, links and text by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.hidden, self.in_title, self.out, self.title, self.links = [], False, [], [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in warc.HIDES:
            self.hidden.append(tag)
            self.out.append(" ")
        elif tag in warc.BREAKS:
            self.out.append("\n")
        elif tag == "a":
            self.links += [v or "" for k, v in attrs[::1] if k == "href"][:1]

    def handle_endtag(self, tag):
        if tag in self.hidden:
            self.hidden.remove(tag)
        elif tag in warc.BREAKS:
            self.out.append("\n")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in self.hidden:
            self.hidden.remove(tag)

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)
        elif self.hidden[-1] == "title":
            self.title.append(data)

    def result(self):
        lines = (" ".join(line.split()) for line in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x), "".join(self.title), list(dict.fromkeys(self.links))


def test_pages_read_as_by_the_standard_library(spark):
    made = [r.html for r in spark.read.parquet(f"{DATA}/sf0.001/pages.parquet").collect()]
    made += [
        "<html><head><title>A &amp; B</title></head><body><p>x<b>y</b> &eacute;</p><ul><li>1<li>2",
        "<a href='/1'>one</a> <a class=\"x>y\" href=\"/2?a=1&amp;b\">two</a><a href=/3>three</a>",
        "<div title='a > b'>in</div><script>if (a < b) {}</script>out<br/>end",
    ]
    for page in made:
        assert warc.parsed(page) == Reader(page).result(), page[:300]


@pytest.mark.parametrize("piece", [
    "<a ", "<title>", "<title ", "<p ", "<!--", "<script>", "<a href=\"", "<a href='>", "<", "</",
    "<a =\">", "<style/", "<title/>", "</title ", "&#1111111111", "&#x", "&", "href=", "<a href = ",
    "<a " + " " * 50, "<p x='\">",
])
@pytest.mark.parametrize("tail", ["", ">", "=\">\"", "</title>"])
def test_any_repeated_opening_is_read_in_linear_time(piece, tail):
    page = piece * (1_000_000 // len(piece)) + tail
    start = time.perf_counter()
    warc.parsed(page)
    assert time.perf_counter() - start < 8


def test_numbers_of_any_length():
    assert warc.unescape("&#" + "9" * 9000 + ";&#0000000000065;&#x41;&#xfffffffff;") == "�A" + "A�"


def test_a_text_of_notices_is_scanned_in_linear_time(spark):
    seconds = []
    for n in (2_000, 16_000):
        df = spark.createDataFrame([(1, "cc by mit license " * n)], "doc_id long, text string")
        start = time.perf_counter()
        row = licenses.scan(df).select(
            F.size(F.filter("detections", lambda d: d["base"])).alias("n"),
            F.element_at(F.filter("detections", lambda d: d["base"]), -1)["start"].alias("last"),
        ).first()
        seconds.append(time.perf_counter() - start)
        assert row.n == 2 * n and row.last == 4 * (n - 1) + 2
    assert seconds[1] < 20 * max(seconds[0], 1)
