"""The registered queries, by name, on small tables with nulls, repeats, ties and long texts, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tallyframe.llm import decontaminate as de
from tallyframe.llm import queries
from tallyframe.llm import url_filter as uf

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def sw(a, b):
    above, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, above[j - 1] + (de.MATCH if x == y else -de.MISS), above[j] - de.MISS, row[-1] - de.MISS))
        best, above = max(best, *row), row
    return best


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, rnd = str(tmp_path_factory.mktemp("tables")), random.Random(12)
    vocab = {lang: ["".join(rnd.choice(x) for _ in range(rnd.randint(2, 7))) for _ in range(300)] for lang, x in (("aa", "abcdefgh"), ("bb", "mnopqrstu"))}
    items = [" ".join(rnd.choice(vocab["aa"]) for _ in range(20)) for _ in range(3)] + ["yes", None, ""]
    docs = []
    for i in range(150):
        lang = "aa" if i % 3 else "bb"
        lines = [" ".join(rnd.choice(vocab[lang]) for _ in range(rnd.randint(1, 25))) for _ in range(rnd.randint(1, 6))]
        if i % 20 == 0:
            lines.insert(1, items[i // 20 % 3])
        docs.append((i, "\n".join(lines), lang if i % 5 else None, f"s{i % 4}" if i % 7 else None, 1))
    docs += [(200 + i, docs[i][1] + rnd.choice(["", " ", " end"]), docs[i][2], "s9", 1) for i in range(30)]
    docs += [(300, None, "aa", "s1", None), (301, "", None, None, 0), (302, " \n ", "aa", "s0", 3), (None, docs[3][1], "aa", "s0", 1), (3, docs[3][1], "aa", "s0", 1), (4, "yes Yes 123", None, "s2", 1), (303, "123 !?", "aa", None, 6)]
    docs.append((304, "\n".join(" ".join(rnd.choice(vocab["aa"]) for _ in range(8)) for _ in range(3000)), "aa", "s1", 1))
    spark.createDataFrame(docs, DOC).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(0, 150)] + [(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    urls = ["https://Www.free-poker.example.net/slots?x", "http://citylibrary.example.org/es/1", "http://example.com/de/1#a", "http://x.example.com/fr/", None, "no url", "://", "http://a.org", "http://é.example.net/a b/ü", "http://example.org/en/12"]
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>A line of text, long enough to be one.</p></article><footer>&copy; x</footer></body></html>"
    pages = [(k, u, page if k % 2 else None) for k, u in enumerate(urls)] + [(0, urls[0], "<p>"), (None, urls[1], page)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder, docs, items, pages


def got(spark, tables, name):
    return queries.QUERIES[name](spark, tables[0]).collect()


def test_op1(spark, tables):
    _, docs, items, _ = tables
    want = set()
    for d in docs:
        for k, item in enumerate(items):
            w = words(item)
            if len(w) >= de.FLOOR and d[1]:
                best = sw(w, words(d[1]))
                if best >= max(de.LEAST * de.MATCH * len(w), de.MATCH * de.FLOOR):
                    want.add((d[0], k, round(best / (de.MATCH * len(w)), 9)))
    rows = got(spark, tables, "op1_decontaminate")
    assert {(r["doc_id"], r["item_id"], round(r["score"], 9)) for r in rows} == want and len(rows) == len(want)


def test_op2(spark, tables):
    _, docs, _, _ = tables
    rows = got(spark, tables, "op2_language_id")
    assert Counter(r["doc_id"] for r in rows) == Counter(d[0] for d in docs)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    by_id = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert {by_id[k] for k in (300, 301, 302, 303)} == {"und"}
    assert sum(by_id[i] == ("aa" if i % 3 else "bb") for i in range(150)) >= 147


def test_op3(spark, tables):
    _, docs, _, _ = tables
    rows = got(spark, tables, "op3_mixing")
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d[0], len(words(d[1]))) for d in docs)
    sizes = Counter()
    for d in docs:
        sizes[d[3]] += len(words(d[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target, left = {}, list(order)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    rest = sum(sizes.values())
    while left:
        share = rest / sum(weight[s] for s in left)
        full = [s for s in left if weight[s] * share > 3 * sizes[s]]
        if not full:
            target |= {s: weight[s] * share for s in left}
            break
        for s in full:
            target[s] = 3 * sizes[s]
            rest -= target[s]
            left.remove(s)
    taken = Counter()
    for r in rows:
        s = next(d[3] for d in docs if (d[0], len(words(d[1]))) == (r["doc_id"], r["size"]) and sizes[d[3]] == r["source_size"])
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert sorted(map(repr, rows)) == sorted(map(repr, got(spark, tables, "op3_mixing")))


def test_op4(spark, tables):
    _, docs, _, _ = tables
    key = {r["text"]: r["k"] for r in spark.createDataFrame(docs, DOC).selectExpr("text", "xxhash64(text) k").collect()}
    seen, gone = [], {}
    lines = sorted({((d[0] is None, d[0] or 0, key[d[1]], k), frozenset(words(x))) for d in docs if d[1] for k, x in enumerate(d[1].split("\n"))}, key=lambda x: x[0])
    for at, s in lines:
        if s:
            if any(100 * len(s & o) >= 80 * len(s | o) for o in seen if 4 * len(s) <= 5 * len(o) and 4 * len(o) <= 5 * len(s)):
                gone.setdefault((at[0], at[1], at[2]), []).append(at[3])
            seen.append(s)
    want = [(d[0], len(d[1].split("\n")) if d[1] else 0, len(g := gone.get((d[0] is None, d[0] or 0, key[d[1]]), []) if d[1] else []), ",".join(map(str, sorted(g)))) for d in docs]
    assert sorted(map(repr, (tuple(r) for r in got(spark, tables, "op4_line_dedup")))) == sorted(map(repr, want))


def test_op5(spark, tables):
    _, docs, _, _ = tables
    rows = got(spark, tables, "op5_sharding")
    want = Counter((d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s])) and s in range(16) for s in counts)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


def test_op6(spark, tables):
    _, docs, _, _ = tables
    sets = [{tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if (w := words(d[1])) else set() for d in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(docs):
        low.setdefault(find(i), []).append(d[0])
    want = [(d[0], len(sets[i]), min(x for x in low[find(i)] if x is not None) if sets[i] else d[0]) for i, d in enumerate(docs)]
    assert sorted(map(repr, (tuple(r) for r in got(spark, tables, "op6_jaccard_join")))) == sorted(map(repr, want))


def test_op7(spark, tables):
    rows = got(spark, tables, "op7_html_extract")
    pages = tables[3]
    assert Counter((r["page_id"], r["url"]) for r in rows) == Counter((p[0], p[1]) for p in pages)
    text = "Title\nA line of text, long enough to be one."
    for r in rows:
        full = r["page_id"] is None or r["page_id"] % 2 == 1
        assert (r["text"], r["n_chars"]) == ((text, len(text)) if full else ("", 0))


def test_op8(spark, tables):
    rows = got(spark, tables, "op8_url_filter")
    pages = tables[3]
    judge, want = uf.Judge(uf.frequencies()), Counter()
    for page_id, u, _ in pages:
        host = path = ""
        if u and "://" in u:
            host, path = re.fullmatch(r"([^/?#]*)([^?#]*).*", u.split("://", 1)[1], re.S).groups()
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(h + p, v) for h, p, v in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        want[page_id, host, path, rule, verdict or ("block" if judge.judge(host, path)[1] > 0 else "allow")] += 1
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows) == want
    assert {r["verdict"] for r in rows if r["page_id"] == 0} == {"block"}


def test_url_rules_against_sql(spark, tables):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tables[0]}/pages.parquet/*.parquet'")
    df = queries.QUERIES["llm_url_rules"](spark, tables[0]).filter("page_id is not null and page_id <> 0")
    want = con.execute("SELECT page_id, host, path, rule, ruled FROM (" + queries.ORACLE_SQL["llm_url_rules"] + ") WHERE page_id > 0").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select("page_id", "host", "path", "rule", "ruled").collect()))) == sorted(map(repr, want))


def test_op9(spark, tables):
    _, docs, _, _ = tables
    groups = {}
    for d in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", d[1] or ""), []).append((-len(d[1] or ""), d[0] is None, d[0] or 0, d[0]))
    want = Counter()
    for d in docs:
        norm = re.sub(r"[\x20\x09-\x0D]", "", d[1] or "")
        keep = min(groups[norm])[3]
        want[d[0], keep, len(groups[norm]), d[0] == keep, hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got(spark, tables, "op9_exact_dedup")) == want


def test_op10(spark, tables):
    _, docs, _, _ = tables
    rows = got(spark, tables, "op10_quality")
    assert Counter(r["doc_id"] for r in rows) == Counter(d[0] for d in docs)
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert not kept[300] and not kept[301] and sum(kept[i] for i in range(150)) >= 140
    assert all(not r["kept"] or r["perplexity"] <= r["threshold"] for r in rows)


@pytest.mark.parametrize("name", ["llm_mix_targets", "op4_line_dedup", "op6_jaccard_join", "op9_exact_dedup"])
def test_against_sql(spark, name):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    df = queries.QUERIES[name](spark, data)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
