"""Url filters, main text, WARC audit and license scans on small fixtures."""

import collections
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from exprlake.llm import extract, licenses, queries, urls, warc

RULES = queries.URL_RULES


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://A.Example.ORG/es/5?x#y", "a.example.org", "/es/5", "example.org/es/", "block"),
        ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://notexample.org/en/12", "notexample.org", "/en/12", "org/", "allow"),
        ("https://x.com/de/", "x.com", "/de/", "com/de/", "block"),
        ("https://x.com/fr/a", "x.com", "/fr/a", "com/fr/", "allow"),
        ("https://x.org", "x.org", "", None, None),
        ("https://x.org?/es/", "x.org", "", None, None),
        ("a b://h.net#z/y", "h.net", "", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("http://a.org/p\nq://b/c", "a.org", "/p\nq://b/c", "org/", "allow"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "x", 0.0)], "page_id long, url string, template string, purity double")
    row = urls.judge(pages, RULES).first()
    assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
    assert row["verdict"] == (verdict or row["verdict"]) and row["verdict"] in ("allow", "block")


def test_templates_learn_from_labelled_urls(spark):
    rows = [(f"http://s.net/bad/{i}",) for i in range(60)] + [(f"http://s.net/good/{i}",) for i in range(60)]
    rules = [("block", "s.net", "/bad/1"), ("block", "s.net", "/bad/3"), ("allow", "s.net", "/good/1"), ("allow", "s.net", "/good/2")]
    pages = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string")
    found = urls.judge(pages, rules).where("rule is null").groupBy("template").agg(F.collect_set("verdict").alias("v")).collect()
    assert {r["template"]: r["v"] for r in found} == {"/bad/{n}": ["block"], "/good/{n}": ["allow"]}


def plain_templates(urls_):
    """Purity of every (host, segments) of [(host, segments, blocked)], one host and one node after the other."""
    urls_ = [(h, tuple(s), b) for h, s, b in urls_]
    labels = [b for *_, b in urls_ if b is not None]
    overall = (sum(labels) + 0.5) / (len(labels) + 2.0)
    out = {}

    def count(rows):
        mine = [b for _, b in rows if b is not None]
        return len(mine), sum(mine)

    def grow(host, rows, level, purity):
        l, h = count(rows)
        if l == 0 or len({s for s, _ in rows}) < 2:
            out.update({(host, s): purity for s, _ in rows})
            return
        step = lambda s: s[level] if level < len(s) else ""
        own = collections.Counter(step(s) for s, _ in rows)
        once = sum(n == 1 for n in own.values())
        keep = {t for t, n in own.items() if t == "" or t.startswith("{n}") or (n >= urls.KEEP_SHARE * len(rows) and (n > 1 or once < urls.VARIABLE))}
        parts = collections.defaultdict(list)
        for s, b in rows:
            parts[step(s) if step(s) in keep else "*"].append((s, b))
        for t, part in parts.items():
            cl, ch = count(part)
            alike = cl == 0
            if cl and l > cl:
                p = h / l
                alike = abs(ch / cl - (h - ch) / (l - cl)) <= urls.CRITICAL * math.sqrt(p * (1 - p) * (1 / cl + 1 / (l - cl)))
            share = purity if alike else (ch + urls.PRIOR * purity) / (cl + urls.PRIOR)
            if t == "":
                out.update({(host, s): share for s, _ in part})
            else:
                grow(host, part, level + 1, share)

    for host in {h for h, *_ in urls_}:
        rows = [(s, b) for h, s, b in urls_ if h == host]
        l, h = count(rows)
        grow(host, rows, 0, (h + urls.PRIOR * overall) / (l + urls.PRIOR))
    return out


def held_against_plain(pages):
    seen = pages.select(urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    seen = seen.withColumn("fit", urls.rule_of(queries.URL_RULES, F.col("host"), F.col("path"))).select("host", urls._segments(F.col("path")).alias("segments"), (F.col("fit.verdict") == "block").alias("blocked"))
    expected = plain_templates([tuple(r) for r in seen.collect()])
    found = {(r["host"], tuple(r["segments"])): r["purity"] for r in urls.templates(seen).select("host", "segments", "purity").collect()}
    assert found.keys() == expected.keys() and all(math.isclose(found[k], expected[k], rel_tol=1e-9) for k in found)
    return len(found)


def test_templates_equal_a_plain_walk(spark):
    assert held_against_plain(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")) > 100


def test_templates_of_odd_trees_equal_a_plain_walk(spark):
    draw = random.Random(11)
    hosts = ["a.org", "example.org", "b.com", "c.com", "d.net"]
    made = []
    for _ in range(1_500):
        depth = draw.choice([0, 1, 2, 3, 5, 9])
        made.append((f"http://{draw.choice(hosts)}/" + "/".join(draw.choice(["fr", "de", "es", "x", "y", str(draw.randint(0, 99)), f"p{draw.randint(0, 60)}"]) for _ in range(depth)),))
    assert held_against_plain(spark.createDataFrame([*made, (None,), ("no address",), ("http://a.org/" + "long/" * 40 + "q" * 5_000,)], "url string")) > 500


def test_deep_paths_are_told_apart(spark):
    """What tells blocked from allowed pages stands on the fifth step."""
    rules = [("block", "deep.net", "/a/b/c/bad/1"), ("allow", "deep.net", "/a/b/c/good/1")]
    pages = [(n, f"http://deep.net/a/b/c/{kind}/{n}") for n in range(10, 49) for kind in ("bad", "good")]
    found = {r["path"]: r["verdict"] for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules).where("rule is null").collect()}
    assert len(found) == 58 and all(v == ("block" if "/bad/" in p else "allow") for p, v in found.items())


def test_few_siblings_are_no_variable_segment(spark):
    """Four languages that stand once or twice keep their own labels."""
    rules = [("block", "small.com", "/de/"), ("allow", "small.com", "/fr/")]
    pages = [(1, "http://small.com/de/1"), (2, "http://small.com/de/2"), (3, "http://small.com/fr/1"), (4, "http://small.com/en/210"), (5, "http://small.com/es/254")]
    found = {r["page_id"]: r["template"] for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}
    assert not any(t.startswith("/*") for t in found.values())


def test_urls_empty_and_repeated(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")] * 3 + [(None, "http://a.net/y")], "page_id long, url string")
    assert urls.judge(pages, RULES).count() == 4 and urls.judge(pages.limit(0), RULES).count() == 0


PAGE = """<html><body><div class="cookie-notice">We use cookies</div><header><h1>Site</h1></header><div id="wrap"><div class="sidebar"><p>side text that
is long enough</p></div><div class="content post-{n}"><h2>Title &amp; more</h2><p>One <a href=x>link</a> para<br>two &lt;3 {n}<ul><li>a<li>b</ul><script>var x="</p>";</script>
<div class=ad>buy</div><form>f<input></form><p>Last   words</div><div class="comments"><p>a long reader comment that is much longer than the article so it would win by far otherwise</p></div></div><footer>foot</footer></body></html>"""


def test_main_text(spark):
    rows = [(k, f"http://h.net/{k}", PAGE.replace("{n}", str(k))) for k in range(12)] + [(100, None, None), (101, "http://h.net/e", ""), (102, "http://q.net", "only text"), (None, "http://h.net/9", PAGE)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    found = {r["page_id"]: r for r in extract.main_text(pages).collect()}
    assert found[3]["text"] == "Title & more\n\nOne link para two <3 3\n\na\n\nb\n\nLast words"
    assert found[3]["n_chars"] == len(found[3]["text"]) and found[3]["path"].endswith("div.content.post-#")
    assert [found[k]["text"] for k in (100, 101, 102)] == ["", "", "only text"] and len(found) == len(rows)
    assert extract.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "wrapper",
    ["main class='content no-sidebar'", "article class='post has-comments'", "div class='with-sidebar'", "div class='content-sidebar-wrap'", "div id='layout-sidebar'", "div class='widget'", "main class='comments'", "div class='modal overlay'", "article id='related'"],
)
def test_wrappers_named_after_boilerplate_keep_their_text(wrapper):
    story = "<p>" + "story text that is long enough " * 9 + "</p>"
    page = f"<body><div class='menu'><a href=x>one</a> <a href=y>two</a></div><{wrapper}>{story}<div class='sidebar'>side</div><div class='post-comments'>said</div><p>end</p></{wrapper.split()[0]}><div class='site-footer'>foot</div></body>"
    assert extract.proposal(page)[0].rsplit("/", 1)[-1].startswith(wrapper.split()[0])
    text = extract.extract(page, [])[0]
    assert text.startswith("story text") and text.endswith("end") and not any(x in text for x in ("side", "said", "foot", "one"))


def test_nothing_but_marked_elements():
    assert extract.extract("<body><div class='ad'><p>a few words</p></div><div class='comments'>more of them</div><script>x</script><nav>menu</nav></body>", [])[0] == "a few words\n\nmore of them"
    assert extract.extract("<body><div class='comments'><p>only words</p></div></body>", [])[0] == "only words"
    assert extract.extract("<body><div><p>short story</p><div class='comments'><p>" + "long comment " * 30 + "</p></div></div></body>", [])[0] == "short story"
    assert extract.extract("<body><article><p>short story</p></article><div class='ad'>" + "long advert " * 30 + "</div></body>", [])[0] == "short story"
    assert extract.extract("<body><main><article><h1>Title</h1><div class='widget'>" + "story " * 30 + "</div></article></main></body>", [])[0].endswith("story")
    assert extract.extract("<body><main><article>short story</article><div class='ad'>" + "long advert " * 30 + "</div></main></body>", [])[0] == "short story"
    assert extract.extract("<body><main hidden>none</main></body>", []) == ("", "")


def test_host_vote_overrules_a_page(spark):
    plain = "<body><div class='story'><p>{}</p></div><div class='box'><p>{}</p></div></body>"
    rows = [(k, "http://v.net/a", plain.format("story text " * 30, "short")) for k in range(9)] + [(9, "http://v.net/b", plain.format("a story", "boxed text " * 40))]
    found = {r["page_id"]: r["text"] for r in extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[9] == "a story"


def test_fixity(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "<p>ü" * (k % 7)) for k in range(2300)] + [(None, None, None), (5, "http://h/5", None)], "page_id long, url string, html string")
    good = warc.records(pages)
    assert warc.audit(good, warc.records(pages)).where("corrupt or not root_ok").count() == 0
    broken = pages.withColumn("html", F.when(F.col("page_id").isin(17, 1500), F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    found = warc.audit(good, warc.records(broken))
    assert found.count() == 2302
    # a longer record moves what follows it in its archive
    first = found.where("corrupt").groupBy("archive").agg(F.min("key").alias("k")).collect()
    assert {(r["archive"], r["k"]) for r in first} == {(0, 17), (1, 1500)}
    assert found.where("not root_ok").select("archive").distinct().count() == 2
    lost = warc.records(pages.where("page_id <> 2299 or page_id is null"))
    assert [r["key"] for r in warc.audit(good, lost).where("corrupt").collect()] == [2299]
    assert [r["key"] for r in warc.audit(lost, good).where("corrupt").collect()] == [2299]
    assert warc.audit(good.limit(0), good.limit(0)).count() == 0


def test_fixity_finds_exactly_the_corrupt_records(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "<p>" + "ü" * (k % 7 + 2)) for k in range(2300)] + [(5, "http://h/5", "<p>twin")], "page_id long, url string, html string")
    id_, html = F.col("page_id"), F.col("html")
    broken = pages.where("page_id not in (300, 1100)").withColumn("html", F.when(id_ == 17, F.concat(html, F.lit("!"))).when(id_ == 700, F.substring(html, 1, 3)).when(id_.isin(1500, 1501), F.lit("?")).otherwise(html))
    broken = broken.unionByName(spark.createDataFrame([(1200, "http://h/more", "more"), (5, "http://h/5", "<p>twin"), (2100, "http://h/2100", "<p>2")], pages.schema))
    found = warc.audit(warc.records(pages), warc.records(broken)).where("corrupt").collect()
    changed, missing, extra = {17, 700, 1500, 1501}, {300, 1100}, {1200, 5, 2100}
    assert sorted((r["key"], r["state"]) for r in found) == sorted([(k, "changed") for k in changed] + [(k, "missing") for k in missing] + [(k, "extra") for k in extra])
    back = warc.audit(warc.records(broken), warc.records(pages)).where("corrupt").collect()
    assert {(r["key"], r["state"]) for r in back} == {(k, "changed") for k in changed} | {(k, "extra") for k in missing} | {(k, "missing") for k in extra}


def test_decayed_replica_loses_grows_and_truncates(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "<p>textü") for k in range(3000)] + [(None, None, None)], "page_id long, url string, html string")
    rotten = {r["page_id"] for r in pages.where(F.sha2(F.col("page_id").cast("string"), 256) < "05").collect()}
    replica = warc.decayed(pages)
    bodies = {r["page_id"]: r["html"] for r in replica.collect()}
    assert {len(bodies[k]) if k in bodies else 0 for k in rotten} == {0, 4, 8, 9}
    found = warc.audit(warc.records(pages), warc.records(replica))
    assert found.count() == 3001 and {r["key"] for r in found.where("corrupt").collect()} == rotten


def test_records_are_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(k, "http://h", "body") for k in range(3)], "page_id long, url string, html string")
    warc.write_archives(warc.records(pages), f"{tmp_path}/w")
    text = spark.read.text(f"{tmp_path}/w", wholetext=True).first()["value"]
    assert text.count("WARC/1.0\r\n") == 3 and text.count("Content-Length: 4\r\n") == 3


@pytest.mark.parametrize("name", ["op2_warc_fixity", "op4_ngram_jaccard"])
def test_sql_oracles(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    ours = queries.QUERIES[name](spark, sf)
    columns = sorted(ours.columns)
    theirs = con.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(str, map(tuple, ours.select(columns).collect()))) == sorted(map(str, theirs))


def test_licenses(spark):
    texts = ["All rights reserved. CC-BY, cc by", "the General   Public License", "Released under the MIT License.", None, "", "words only", "Licensed under the Apache License, Version 2.0. " + "x " * 500, "ALL\nRIGHTS\nRESERVED all rights reserved", "a " * 1000 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"]
    docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)] + [(None, texts[0], "z")], "doc_id long, text string, labels string")
    found = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert tuple(found[0])[1:7] == (7, 3, 0, 5, "cc-by,reserved", "cc-by,reserved") and found[0]["score"] == 1.0
    assert tuple(found[1])[1:7] == (4, 1, 1, 1, "gpl", "gpl")
    assert (found[2]["labels"], found[2]["base_labels"], found[2]["first_word"], found[2]["score"]) == ("mit", "", None, 1.0)
    assert tuple(found[3])[1:8] == tuple(found[4])[1:8] == (0, 0, None, None, "", "", 0.0)
    assert found[5]["score"] == 0.0 and found[6]["labels"] == "apache-2.0" and found[8]["labels"] == "mit"
    assert (found[7]["n_base"], found[7]["first_word"], found[7]["last_word"]) == (2, 0, 3)
    assert len(found) == len(texts) + 1 and licenses.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ("Licensed under CC BY 4.0", "cc-by"),
        ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
        ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
        ("CC BY-SA 4.0", "cc-by-sa"),
        ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc-sa"),
        ("Released under the BSD License", "bsd"),
        ("Released under the MIT License", "mit"),
        ("Licensed under the Mozilla Public License, Version 2.0", "mpl-2.0"),
        ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
        ("This work is licensed under the GNU General Public License, version 2", "gpl-2.0"),
        ("GNU General Public License, version 2", "gpl-2.0"),
        ("This work is licensed under the GNU General Public License, version 3", "gpl-3.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 3", "lgpl-3.0"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3.0"),
        ("This work is licensed under a Creative Commons Attribution License", "cc-by"),
        ("Creative Commons Attribution License", "cc-by"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike License", "cc-by-sa"),
        ("The album was released in May and sold under the counter, until the shop lost its license", ""),
        ("Creative Commons Attribution-NonCommercial-ShareAlike License", "cc-by-nc-sa"),
        ("Licensed under CC BY 4.0, the figures under CC BY-NC 4.0", "cc-by,cc-by-nc"),
    ],
)
def test_notices_are_told_from_their_siblings(text, want):
    index, block = licenses.TemplateIndex({}), licenses.words("some words before it " + text + " and some words after it")
    found = {licenses.TEMPLATES[k][0] for k, s, _ in index.matches(block) if licenses.Notice(*licenses.TEMPLATES[k]).share(block[s : s + licenses.BLOCK])}
    assert ",".join(sorted(found)) == want


def test_sibling_notices_in_a_scan(spark):
    texts = ["Released under the BSD License", "Licensed under the Mozilla Public License, Version 2.0", "The song was released under the old name and the license ran out"]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["labels"] for r in rows} == {0: "bsd", 1: "mpl-2.0", 2: ""}
    assert max(len(licenses.words(t)) + max(4, len(licenses.words(t)) // 4) for _, t in licenses.TEMPLATES) <= licenses.BLOCK // 2 + 1


def test_template_join_equals_brute_force():
    import random

    rng = random.Random(4)
    vocabulary = [w.decode() for _, t in licenses.TEMPLATES for w in licenses.words(t)] + ["alpha", "beta"]
    index = licenses.TemplateIndex({w.encode(): rng.randint(1, 99) for w in vocabulary})
    for _ in range(300):
        words = [rng.choice(vocabulary).encode() for _ in range(rng.randint(0, 200))]
        want = set()
        for s in range(0, max(1, len(words)), 32):
            if s and s + 32 >= len(words):
                continue
            block = set(words[s : s + 64])
            for k, (_, t) in enumerate(licenses.TEMPLATES):
                own = set(licenses.words(t))
                if len(own & block) >= licenses._need(len(own)):
                    want.add((k, s, len(own & block) / len(own)))
        assert set(index.matches(words)) == want


def test_hidden_is_an_attribute_not_a_word():
    page = '<html><body><div title="the hidden valley"><p>Shown text of the valley.</p></div><p hidden>Not shown.</p><p hidden="">Nor this.</p></body></html>'
    assert extract.extract(page, [])[0] == "Shown text of the valley."


def test_places_of_a_long_text():
    assert list(licenses._places(b" " + b"cc by " * 200_000, b" cc by ")) == list(range(0, 400_000 - 1, 2))


@pytest.mark.parametrize("tail", ["", "</b>" * 100_000, "</div>" * 100_000])
def test_very_deep_pages(tail):
    page = "<body>" + "<div class='a'>" * 100_000 + "<p>deep story" + tail
    text, path = extract.extract(page, ["#/body/main", "#/body/div.a"])
    assert (text, path) == ("deep story", "#/body/div.a")
    assert extract.extract(page, [])[0] == "deep story"


def test_classes_with_slashes_are_one_step():
    page = "<body><div class='w-1/2'><p>some story</p></div><div class='w-1/2'><p>the rest</p></div></body>"
    best = extract.proposal(page)[0]
    assert best == "#/body/div.w-#_#"
    assert extract.extract(page, [best]) == ("some story\n\nthe rest", best)


def test_main_text_broadcasts_or_joins_alike(spark, monkeypatch):
    rows = [(k, f"http://h{k % 2}.org/{k}", f"<body><nav>menu</nav><div class='c{k}'><p>{'story ' * (k + 3)}</p></div></body>") for k in range(8)] * 2
    pages = spark.createDataFrame([*rows, (None, None, None), (9, "", "")], "page_id long, url string, html string").withColumn("host", F.lit(1))
    small = sorted(map(str, extract.main_text(pages).collect()))
    assert len(small) == 18
    monkeypatch.setattr(extract, "BROADCAST_CHARS", -1)
    assert sorted(map(str, extract.main_text(pages).collect())) == small
    assert extract.main_text(pages.limit(0)).count() == 0
