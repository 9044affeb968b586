"""Operators 1, 2, 3 and 5 against plain versions."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from grainline.llm import components, decontamination, licenses, quality, urls

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    held = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(held)


def test_quality_counts(spark, sf, docs):
    rows = {r.doc_id: r for r in quality.op3_quality_cascade(spark, sf).collect()}
    assert len(rows) == len(docs)
    for i, t in docs:
        r, (n, *rest) = rows[i], plain_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 50 or 100 * rest[-1] > 50 * n)
        assert not (r.base_failed and r.kept)


def test_quality_awkward(spark, awkward):
    d = awkward("n_words")
    rows = quality.judged(d).collect()
    assert len(rows) == 10 and not any(r.kept for r in rows)
    assert {(r.n_words, r.n_repeat_words) for r in rows if r.doc_id == 7} == {(30_000, 30_000)}
    assert quality.judged(d.limit(0)).count() == 0
    assert quality.judged(d).where("kept OR n_words > 2").count() == 6


def test_cascade_order_changes_nothing(spark, sf):
    d = quality.measured(spark.read.parquet(f"{sf}/documents.parquet"))
    rules = list(quality.RULES)
    failed = lambda rs: {r.doc_id for r in d.select("doc_id", quality.cascade(d, rs).alias("f")).where("f IS NOT NULL").collect()}
    assert failed(rules) == failed(rules[::-1]) != set()
    assert sorted(r.name for r in quality.ordered(spark.read.parquet(f"{sf}/documents.parquet"))) == sorted(r.name for r in rules)


def test_whole_cascade_keeps_the_same(spark, sf, awkward):
    for d in (spark.read.parquet(f"{sf}/documents.parquet"), awkward("n_words"), awkward("kept")):
        got = quality.accepted(d)
        assert got.schema == d.schema
        names = [f"c{i}" for i in range(len(d.columns))]
        want = quality.judged(d.toDF(*names), names[d.columns.index("text")]).where("kept").select(*names)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert quality.accepted(awkward().limit(0)).count() == 0
    every = quality.ordered(spark.read.parquet(f"{sf}/documents.parquet"), "text", (*quality.BASE_RULES, *quality.RULES), dear=True)
    assert sorted(r.name for r in every) == sorted(r.name for r in (*quality.BASE_RULES, *quality.RULES))


def test_counts_of_some_rows_only(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    some = quality.measured(d, "text", F.col("n_words") > 100).select("doc_id", *quality.BASE)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, quality.measured(d).where("n_words > 100").select("doc_id", *quality.BASE).collect()))


def test_licences(spark, sf, docs, awkward):
    rows = {r.doc_id: r for r in licenses.op5_rare_word_index(spark, sf).collect()}
    for i, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        at = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = rows[i]
        want = (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert licenses.scanned(awkward("labels")).count() == 10
    assert licenses.scanned(awkward().limit(0)).count() == 0


def plain_licences(text, index):
    """Labels and score by comparing every template's phrase with every place."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    labels, score = set(), 0.0
    for label, ws, start, phrase, is_base in index.templates:
        for at in range(len(w) - len(phrase) + 1):
            if w[at : at + len(phrase)] == phrase:
                labels.add(label)
                zero = at - start
                own = sum(index.idf[x] for j, x in enumerate(ws) if 0 <= zero + j < len(w) and w[zero + j] == x) / sum(index.idf[x] for x in ws)
                score = max(score, 0.5 if is_base else min(1.0, own))
    return ",".join(sorted(labels)), score


def test_licence_labels_against_every_place(spark, docs):
    """Over all documents, and over notices whole, cut, with a word put in, and repeated with overlaps."""
    import random

    r, index = random.Random(1), licenses.Index()
    made = []
    for _, ws, *_ in index.templates:
        cut, k = r.randint(0, len(ws) // 2), r.randint(0, len(ws))
        made += [" ".join(ws), " ".join(ws[cut:]), " ".join(ws[: len(ws) - cut]), " ".join([*ws[:k], "word", *ws[k:]]), "cc " + " ".join(ws + ws)]
    made += ["cc by " * 5000, "cc cc by nc by nc 4 0 cc by sa", None, ""]
    rows = docs + [(10_000_000 + k, t) for k, t in enumerate(made)]
    got = {x.doc_id: (x.labels, x.score) for x in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        labels, score = plain_licences(t, index)
        assert got[i][0] == labels and got[i][1] == pytest.approx(score), (i, t[:100] if t else t)


@pytest.mark.parametrize("text, labels, score", [
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc", 1.0), ("Released under the MIT License", "mit", 1.0), ("mit license cc by cc by", "cc-by,mit", None),
    ("Apache licence version 2.0", "", 0.0), ("All Rights\nReserved", "reserved", 0.5), ("version 2 0", "", 0.0), ("by nc 4 0 cc", "", 0.0),
])
def test_licence_texts(spark, text, labels, score):
    r = licenses.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.labels == labels and (score is None or r.score == pytest.approx(score))


PAGES = [
    (1, "http://a.com/en/x", '<link rel="canonical" href="http://b.org/1">'), (2, "http://b.org/1#z", '<meta http-equiv="refresh" content="0; url=/2">'), (3, "http://b.org/2", ""),
    (4, "http://c.org/q", "<LINK href=http://b.org/2 rel=canonical>"), (5, None, "<link rel=canonical href=x>"), (6, "http://example.com/en/7", '<link rel="canonical" href="//b.org/9">'),
    (7, "http://b.org/9", None), (8, "http://z.com/en/1", '<link rel="canonical" href="http://b.org/9">'), (9, "nothing", ""), (10, "HTTP://X.COM?x", ""), (11, "http://d.org/a/b", "<!-- <link rel=canonical href=http://b.org/1> -->"),
]


def test_block_spreads_and_allow_wins(spark):
    p = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("verdict", F.lit("old"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(p.drop("html"), urls.page_edges(p)).collect()}
    assert got[1] == ("a.com", "/en/x", "com/en/", "block")
    assert [got[k][3] for k in (2, 3, 4)] == ["block"] * 3 and got[4][2] is None
    assert got[6][2:] == ("example.com/en/7", "allow") and got[7][2:] == (None, "allow") and got[8][3] == "block"
    assert got[5] == got[9] == ("", "", None, "allow") and got[10][:2] == ("x.com", "") and got[11][3] == "allow"
    assert urls.judged(p.drop("html").limit(0), urls.page_edges(p.limit(0))).count() == 0


def test_sql_gives_the_same(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    p = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = urls.judged(p.drop("html"), urls.page_edges(p)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(urls.SQL).fetchall())
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = ["doc_id", *quality.BASE, "base_failed", "kept"]
    assert sorted(map(tuple, quality.op3_quality_cascade(spark, sf).select(names).collect())) == sorted(con.execute(quality.SQL).fetchall())


def test_rules_by_longest(spark):
    rows = ["http://net/de/", "http://sub.example.net/de/88", "http://xnet/de/", "http://example.com/en/6", "http://a.org/es/1"]
    d = spark.createDataFrame([(u,) for u in rows], "url string").select(urls.rule_of(urls.host_of(F.col("url")), urls.path_of(F.col("url"))).alias("r"))
    assert [r.r and r.r.rule for r in d.collect()] == ["net/de/", "example.net/de/8", None, "com/en/", "org/es/"]


def test_verdicts_of_linked_pages_against_union(spark):
    """A hub that 1,500 pages name as canonical, a chain of redirects and scattered links, with repeated pages and pages without a host."""
    rng = random.Random(5)
    site = lambda i: f"http://h{i % 97}.example.{('com', 'net', 'org')[i % 3]}{('/en/', '/de/8/', '/de/7/', '/es/', '/x/', '/en/7/')[i // 3 % 6]}{i}?q={i % 5}"
    links = {i: site(0) for i in range(1, 1501)} | {i: site(i + 1) for i in range(2000, 2150)} | {i: site(rng.randrange(2500, 3000)) for i in range(2500, 2900)}
    rows = []
    for i in range(3000):
        tag = f"<link rel='canonical' href='{links[i]}'>" if i % 2 and i in links else f'<meta http-equiv="refresh" content="0; url={links[i]}">' if i in links else ""
        rows.append((i, site(i), f"<html><head>{tag}</head><p>text</p></html>"))
    rows += [(3000 + k, url, html) for k, (_, url, html) in enumerate(rows[::7])] + [(9000 + k, None if k % 2 else "no address", "<p>x</p>") for k in range(300)]
    split = lambda url: re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups() if "://" in (url or "") else ("", "")

    def rule(url):
        host, path = split(url)
        fits = [(len(r), v, r) for v, r in urls.RULES for own, rest in [r.split("/", 1)] if (host == own or host.endswith("." + own)) and path.startswith("/" + rest)]
        return max(fits)[1:] if fits else (None, None)

    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for i, to in links.items():
        up[root(site(i))] = root(to)
    found = collections.defaultdict(set)
    for x in list(up):
        found[root(x)].add(rule(x)[0])
    spread = {x for x in up if "block" in found[root(x)] and "allow" not in found[root(x)]}
    want = sorted((i, *split(url), rule(url)[1], rule(url)[0] or ("block" if url in spread else "allow")) for i, url, _ in rows)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    got = urls.judged(pages, urls.page_edges(pages)).select("page_id", "host", "path", "rule", "verdict")
    key = lambda r: (r[0], str(r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert {(r, v) for _, _, _, r, v in want if r is None} == {(None, "allow"), (None, "block")}


def test_components_against_union(spark):
    import random

    r = random.Random(5)
    for n, m in ((30, 25), (200, 260), (5, 0)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(1000, 1040)] * (m > 0) + [(1, 1), (None, 2)]
        up = {}
        find = lambda x: x if up.setdefault(x, x) == x else find(up[x])  # noqa: E731, B023
        for a, b in edges:
            if a is not None and a != b:
                a, b = sorted((find(a), find(b)))
                up[b] = a
        got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for x in up}


ITEM = "A farmer called John has 12 apples and gives Mary 5 apples. How many apples does John have left?"
QUESTIONS = [
    (1, "Intro text here. A farmer called Peter has 40 apples and gives Susan 7 apples. How many apples does Peter have left? End of it."),
    (2, "A farmer called Peter has 40 apples and gives Susan 7 apples. How many apples does Victor have left?"),
    (3, "a FARMER called John has 12 apples and gives Mary 5 apples how many apples does John have left"),
    (4, None), (5, "short one"), (6, "the short one here"), (7, "nothing to see here at all in this text"), (7, "nothing to see here at all in this text"), (8, ""), (9, "How many apples does John have"),
]


def test_reparameterised_questions(spark):
    b = spark.createDataFrame([(0, ITEM), (1, "short one"), (2, None), (3, ""), (4, "12 + 5 = 17"), (5, "who wrote Hamlet")], "item_id long, text string")
    same_name = "A farmer called Peter has 12 apples and gives Peter 5 apples. How many apples does Peter have left?"
    more = [(10, same_name), (11, "It is known that 12 + 5 = 17 holds."), (12, "It is 12 + 5 = 18."), (13, "They asked who wrote Hamlet and why."), (14, ITEM.lower()), (15, ITEM.replace(" ", "\n"))]
    half = ITEM.split()
    more += [(None, " ".join(half[:11])), (None, " ".join(half[9:])), (None, ITEM), (16, " ".join(half[:11])), (16, " ".join(half[9:]))]
    q = spark.createDataFrame(QUESTIONS + more, "doc_id long, text string").withColumn("item_id", F.lit(99))
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(q, b).collect()}
    assert got == {(1, 0), (3, 0), (5, 1), (6, 1), (11, 4), (13, 5), (14, 0), (15, 0), (None, 0)}
    left = [(r.doc_id, r.text) for r in decontamination.clean(q, b).collect()]
    assert sorted(i for i, _ in left if i is not None) == [2, 4, 7, 7, 8, 9, 10, 12, 16, 16] and sum(i is None for i, _ in left) == 2
    assert decontamination.matches(q.limit(0), b).count() == decontamination.matches(q, b.limit(0)).count() == 0


def plain_matches(docs, items, size=decontamination.WINDOW, share=decontamination.SHARE):
    """Pairs (document, item) by comparing every window of every item with every window of every document; rows are (id, words, slots)."""

    def grams(rows, short):
        for i, words, slots in rows:
            for k in {size, *short} if len(words) >= size or short else ():
                for p in range(len(words) - k + 1):
                    own = (slots or [None] * len(words))[p : p + k]
                    yield i, p, (k, *own) if all(x is not None for x in own) else (k, *words[p : p + k]), [x for x in own if x is not None]

    of, by = {}, collections.defaultdict(list)
    short = {len(w) for _, w, _ in items if 0 < len(w) < size}
    for i, words, slots in items:
        k = min(size, len(words))
        for n, p, key, own in grams([(i, words, slots)], {k} if k else ()):
            if len(words) and key[0] == k:
                of.setdefault(n, set()).add(p)
                by[key].append((n, p, own))
    hits = collections.defaultdict(list)
    for i, p, key, own in grams(docs, short):
        for n, at, theirs in by.get(key, ()):
            hits[i, n].append((p, at, tuple(theirs), tuple(own)))
    out = set()
    for (i, n), rows in hits.items():
        for line in {x for p, at, *_ in rows for x in ((p - at) // 8, (p - at) // 8 + 1)}:
            own = sorted({r for r in rows if line - 1 <= (r[0] - r[1]) // 8 <= line})
            counts = collections.Counter(p - at for p, at, *_ in own)
            exact = collections.Counter(p - at for p, at, a, b in own if a == b)
            main = max(counts, key=lambda o: (counts[o], exact[o], -o))
            near = lambda r: (abs(r[0] - r[1] - main), r[0] - r[1] - main)  # noqa: E731, B023
            kept = {}
            for k in (0, 1):
                kept = {}
                for r in sorted(own, key=near):
                    kept.setdefault(r[k], r)
                own = list(kept.values())
            pairs = {x for _, _, a, b in own for x in zip(a, b, strict=True)}
            named = [b for _, b in pairs if b.startswith(decontamination.NAME)]
            fine = len({a for a, _ in pairs}) == len(pairs) and len(set(named)) == len(named)
            if len(own) >= share * len(of[n]) and (fine or sum(a == b for _, _, a, b in own) >= share * len(of[n])):
                out.add((i, n))
    return out


def test_plain_matcher_finds_the_same(spark, sf):
    """Over all documents and items, and over items with other numbers and names put in, in part only and out of step."""
    import random

    r, d = random.Random(3), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    names, made = ["Anna", "Bob", "Carla", "Dan"], []
    for k, row in enumerate(items.collect()):
        words = [str(r.randint(1, 9)) if r.random() < 0.1 else r.choice(names) if r.random() < 0.08 else w for w in row.text.split()]
        cut = r.randint(0, len(words) // 2)
        made += [(100_000 + 2 * k, " ".join(words[cut:])), (100_001 + 2 * k, "some words here " + " ".join([*words[:cut], "very", *words[cut:]]))]
    items = items.unionByName(spark.createDataFrame([(i + 500_000, t) for i, t in made[::3]] + [(900_000, ITEM), (900_001, "Anna has 7")], "item_id long, text string"))
    docs = d.unionByName(spark.createDataFrame(made + [(990_000 + k, t) for k, (_, t) in enumerate(QUESTIONS)], "doc_id long, text string"))
    rows = lambda t, key, f: [(x[0], x[1], x[2]) for x in decontamination.with_template(t, f(F.col("text")), [key]).collect()]
    named, lower = (rows(items, "item_id", f) for f in (lambda c: c, F.lower))
    want = set()
    # both readings of an item are joined at once, so the plain version takes their union window by window
    of = {}
    for i, w, s in named:
        of[i] = (w, s)
    got = {(x.doc_id, x.item_id) for x in decontamination.matches(docs, items).collect()}
    one = plain_matches(rows(docs, "doc_id", lambda c: c), named)
    other = plain_matches(rows(docs, "doc_id", lambda c: c), lower)
    want = one | other
    assert want <= got and len(got) > 50
    extra = {x for x in got - want}
    assert len(extra) <= 0.02 * len(got), extra


def test_shuffled_benchmark_gives_the_same(spark, sf, monkeypatch, docs):
    got = decontamination.op2_template_windows(spark, sf).collect()
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    assert sorted(decontamination.op2_template_windows(spark, sf).collect()) == sorted(got)
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    items = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {(i, k) for i, t in docs for k, x in items if x in plain(t)}
    assert whole <= {(r.doc_id, r.item_id) for r in got}
    halves = {(i, k) for i, t in docs for k, x in items if sum(" ".join(x.split()[j : j + 5]) in plain(t) for j in range(len(x.split()) - 4)) >= 0.4 * (len(x.split()) - 4)}
    assert {(r.doc_id, r.item_id) for r in got} <= halves


def test_template_words(spark):
    d = spark.createDataFrame([("John has 3.5 kg of apples. He gives Mary twelve apples, and keeps 20% of it at 10:30. WOW Bob",)], "t string")
    r = decontamination.with_template(d, F.col("t"), []).first()
    assert r[0] == "john has <num> <unit> of apples he gives <name> <num> apples and keeps <num> <unit> of it at <num> wow <name>".split()
    assert [x for x in r[1] if x] == ["3.5", "kg", decontamination.NAME + "mary", "twelve", "20", "%", "10:30", decontamination.NAME + "bob"]
