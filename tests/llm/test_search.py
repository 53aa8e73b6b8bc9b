"""Nearest neighbours and URL filters."""

import numpy as np
import pytest

from kindred.llm import ann, url_filters


def brute(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, v in ok:
        near = sorted((-float((v * w).sum() / (np.sqrt((w * w).sum()) * np.sqrt((v * v).sum()))), j) for j, w in ok if j != i)[:k]
        out[i] = [j for _, j in near]
    return out


def test_nearest_recall(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(20, 32))
    rows = [(i, [float(x) for x in centres[i % 20] + draw.normal(size=32)]) for i in range(1500)]
    rows += [(9000, None), (9001, [0.0] * 32), (9002, [float("nan")] * 32), (9003, [None, *[1.0] * 31]), (9004, [1.0]), (9005, []), (None, [1.0] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.where("vec_id % 50 = 0 OR vec_id >= 9000"), 5).collect()
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows if i != 9004], 5)
    queries = sorted({r.query_id for r in got})
    assert queries == [i for i in range(0, 1500, 50)]
    hits = sum(r.vec_id in want[r.query_id] for r in got)
    assert hits >= 0.9 * 5 * len(queries) and len(got) == 5 * len(queries)
    for q in queries:
        mine = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all((-a[1], a[2]) < (-b[1], b[2]) for a, b in zip(mine, mine[1:]))


def test_nearest_copies_and_few(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(40)] + [(99, [3.0, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.where("vec_id = 0"), 5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5]
    few = ann.nearest(df.where("vec_id IN (0, 1, 99)"), df.where("vec_id = 0"), 5).orderBy("rank").collect()
    assert [r.vec_id for r in few] == [1, 99]
    assert ann.nearest(df.limit(0), df.limit(0), 5).count() == 0


@pytest.mark.parametrize("parts", [3, 7])
def test_pigeonhole_is_complete(parts):
    draw = np.random.default_rng(parts)
    codes = draw.integers(0, 1 << 16, (500, 4)).astype(np.uint16)
    codes[::3] ^= (draw.random((167, 4)) < 0.3).astype(np.uint16) << 3
    index = ann.Index(codes)
    for radius in (0, 5, 17, 26):
        for code in codes[:: 100 // parts]:
            want = np.flatnonzero(np.bitwise_count(codes ^ code).sum(1, dtype=int) <= radius)
            assert np.array_equal(index.within(code, radius), want)


def judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, tail = rest[:k].translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})), rest[k:]
        path = tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
    best = None
    for verdict, text in rules:
        h, _, p = text.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best[1])):
            best = (verdict, text)
    return host, path, best and best[1], best[0] if best else "allow"


URLS = [
    "http://net/", "http://a.net/x", "https://Example.NET/en/1?q#f", "http://www.example.net/EN/", "http://www.example.net/en/", "http://example.com/de/x", "http://b.example.com/dex", "http://x.org/fr/", "http://org/fr", "http://netx/",
    "http://xnet/", "nothing", "", None, "http://a.net", "http://a.net?x=/", "http://example.net:80/en/", "a://b://net/", "http://..net/y", "http://a.b.c.net/#/en/", "://net/", "http://net/\n/x", "http://example.net/en/",
]


def test_url_filters(spark):
    rows = [(i, u, "mine", i) for i, u in enumerate([*URLS, *URLS, *["http://hot.net/%d" % (k % 3) for k in range(300)]])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule long")
    for rules in (url_filters.RULES, [], [("block", "a.net/"), ("allow", "net/x"), ("block", "b.c.net/"), ("allow", "c.net/")]):
        got = url_filters.url_filters(df, rules, prefix="f_").collect()
        assert sorted(((r.page_id, r.f_host, r.f_path, r.f_rule, r.f_verdict) for r in got), key=str) == sorted(((i, *judge(u, rules)) for i, u, *_ in rows), key=str)
        assert {r.host for r in got} == {"mine"}
    assert url_filters.url_filters(df.select("page_id", "url").limit(0), url_filters.RULES).count() == 0


def test_nested_url_rules_as_table(spark):
    """Nested hosts and nested paths of one host, from a table of rules: as one by one."""
    hosts = ["net", "a.net", "b.a.net", "c-a.net", "a-b.net", "x.b.a.net", "org", "a..org", "ä.org"]
    paths = ["", "/", "/p", "/p/", "/p/q/", "/p/q/é", "/pä", "/p-", "/q/r/s"]
    texts = [h + p for k, h in enumerate(hosts) for n, p in enumerate(paths) if (3 * k + n) % 4]
    rules = [("block" if k % 3 else "allow", x) for k, x in enumerate(texts)]
    urls = [f"http://{h}{p}{s}" for h in [*hosts, "y.a.net", "b.c-a.net", "z.x.b.a.net", "com"] for p in paths for s in ("", "z", "/", "\U0010ffff")]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    table = spark.createDataFrame([*((v, x, 1) for v, x in rules), (None, "com/", 1), ("block", None, 1)], "verdict string, text string, extra int")

    def fits(host, path, text):
        h, slash, p = text.partition("/")
        return (host == h or host.endswith("." + h)) and path.startswith(slash + p)

    for r in url_filters.url_filters(df, table).collect():
        host, path, *_ = judge(r.url, [])
        fit = sorted((-len(x), -len(x.partition("/")[0]), x, v) for v, x in rules if fits(host, path, x))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, fit[0][2] if fit else None, fit[0][3] if fit else "allow"), r.url


def test_many_url_rules(spark):
    """More rules than one task should hold of a host: 120,000 paths of one host, and hosts below it."""
    from pyspark.sql import functions as F

    ids = spark.range(120_000)
    rules = ids.select(F.lit("block").alias("verdict"), F.concat(F.lit("hot.net/"), "id", F.lit("/")).alias("text"))
    pages = ids.select(F.col("id").alias("page_id"), F.concat(F.lit("http://w"), F.col("id") % 7, F.lit(".hot.net/"), F.col("id") * 2, F.lit("/x")).alias("url"))
    got = url_filters.url_filters(pages, rules).groupBy("verdict").agg(F.count("*"), F.sum(F.when(F.col("rule") == F.concat(F.lit("hot.net/"), F.col("page_id") * 2, F.lit("/")), 1)))
    assert sorted(map(tuple, got.collect())) == [("allow", 60_000, None), ("block", 60_000, 60_000)]


def test_neighbours_beside_odd_lengths(spark):
    """A few vectors of another length, whichever hashes come first, do not displace the table's own."""
    from pyspark.sql import functions as F

    from kindred.llm.ann import nearest

    rows = [(i, [float(i + 1), 1.0, float(i * i % 7)]) for i in range(20)]
    odd = spark.range(100, 400).select(F.col("id").alias("vec_id"), F.array(F.lit(2.0)).alias("embedding"))
    first = odd.orderBy(F.xxhash64("vec_id", "embedding")).limit(5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df.union(first), df, 3).collect()
    assert len(got) == 60 and {r.vec_id for r in got} <= set(range(20))
