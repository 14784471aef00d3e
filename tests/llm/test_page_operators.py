"""WARC files and URL filters, and the registered queries and the pipeline on the smallest tables."""

import hashlib
import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.llm import queries, urlfilter, warc

SCHEMA = "page_id bigint, url string, html string, digest string, shard int, kind int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 0, 0) for r in rows], SCHEMA)


def test_warc(spark, tmp_path):
    big = "<p>é" + "x" * 1200
    rows = [(5, "http://a/1", big), (9, None, big), (7, "http://a/\r\n2", big), (1, "u", "small"), (2, "u", "small"), (3, "u", None), (4, "u", ""), (None, "u", big), (6, "u", "\r\n\r\nContent-Length: 3" * 90), (8, "u", "y" * 300_000), (8, "u", "y" * 300_000)]
    outs = []
    for name in "ab":
        folder = str(tmp_path / name)
        (tmp_path / name).mkdir()
        (tmp_path / name / "_temporary-0-shard-00000-00000.warc.gz").write_bytes(b"begun")
        manifest = warc.write(pages(spark, rows), folder, shard_bytes=100_000, roll_bytes=600).orderBy("file").collect()
        outs.append([(m.file, m.sha1, m.records, m.bytes) for m in manifest])
        got = warc.read(spark, folder).drop("file").collect()
    assert outs[0] == outs[1] and len(outs[0]) > 2
    assert sorted(p.name for p in (tmp_path / "a").glob("*.gz")) == [m[0] for m in outs[0]] and not list((tmp_path / "a").glob("_temporary*"))
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = []
    for k, _, t in rows:
        n = len((t or "").encode())
        top = max((j for j, _, x in rows if j is not None and (x or "") == (t or "")), default=None)
        revisit = n >= 1000 and k is not None and k != top
        want.append((k, n, sha(t), "revisit" if revisit else "response", top if revisit else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    ids = [fields["WARC-Record-ID"] for m in outs[0] for record in warc.members(open(tmp_path / "a" / m[0], "rb")) for fields in [warc.parse(record)[0]]]
    assert len(ids) == len(set(ids)) == len(rows) + len(outs[0])
    empty = str(tmp_path / "e")
    assert warc.write(pages(spark, rows).limit(0), empty).count() == 0 and warc.read(spark, empty).count() == 0


def test_broken_archive_is_an_error():
    record = warc.page_record(1, "u", b"abc", None, "2024-01-01T00:00:00Z")
    fields, block = warc.parse(record)
    assert block.endswith(b"abc") and fields["X-Page-Id"] == "1"
    with pytest.raises(ValueError):
        warc.parse(record.replace(b"abc", b"abd"))


def test_url_rules(spark):
    urls = ["http://www.Example.COM/en/7?x", "https://x.com/en/8", "http://example.com/en", "ftp://a.net/de/9#f", "http://example.net/de/8/a", "http://b.org/es/1", "http://b.org/fr", "no scheme", None, "", "x://", "http://org/es/", "a://b://com/en/1", "http://notexample.com/en/7"]
    df = spark.createDataFrame([(k, u, "host", "allow") for k, u in enumerate(urls)], "page_id bigint, url string, host string, verdict string")
    outcomes = spark.createDataFrame([("b.org", 1)] * 60 + [("c.org", 0)] * 500 + [("b.org", None), ("", 1)], "host string, bad int")
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge(df, outcomes, {"page_id": F.col("page_id")}).collect()}

    def brute(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = rest[:end].lower(), rest[end:].split("?")[0].split("#")[0]
        fits = [(len(r), v, r) for v, r in urlfilter.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rule = max(fits, default=None)
        return host, path, rule and rule[2], rule[1] if rule else "block" if host == "b.org" else "allow"

    assert got == {k: brute(u) for k, u in enumerate(urls)}
    assert urlfilter.judge(df.limit(0), outcomes.limit(0), {"page_id": F.col("page_id")}).count() == 0


def brute_reputation(marks, hosts):
    """(rate, probability of a rate under 0.3) of each host, by loops and a sum over the density."""
    domain = {h: ".".join(h.split(".")[-3 if h.endswith(".co.uk") else -2 :]) for h in hosts}
    suffix = {d: "co.uk" if d.endswith("co.uk") else d.split(".")[-1] for d in domain.values()}
    n, bad = Counter(), Counter()
    for h, b in marks:
        if b is not None and h:
            for key in (("h", h), ("d", domain[h]), ("s", suffix[domain[h]]), "all"):
                n[key], bad[key] = n[key] + 1, bad[key] + b

    def strength(members):  # (group, member)
        x = y = 0.0
        for g in {g for g, _ in members}:
            own = [m for k, m in set(members) if k == g and n[m]]
            total, k = sum(n[m] for m in own), len(own)
            if not k:
                continue
            p = sum(bad[m] for m in own) / total
            x += sum(n[m] * (bad[m] / n[m] - p) ** 2 for m in own) - p * (1 - p) * (k - 1)
            y += p * (1 - p) * (total - sum(n[m] ** 2 for m in own) / total - (k - 1))
        return min(1e3, max(1.0, (y - x) / x if x > 0 and y > 0 else 1e3))

    ms = strength([(0, ("s", s)) for s in suffix.values()])
    md = strength([(suffix[d], ("d", d)) for d in suffix])
    mh = strength([(domain[h], ("h", h)) for h in hosts])
    prior = lambda m, pages: max(0.5, 1 / (1 / (m + 1) + 1 / (pages + 1)) - 1)
    shrink = lambda key, k, above: ((bad[key] + k * above) / (n[key] + k), n[key] + k)
    out = {}
    for h in hosts:
        d = domain[h]
        rate, pages = shrink(("s", suffix[d]), prior(ms, n["all"] + 2), (bad["all"] + 1) / (n["all"] + 2))
        rate, pages = shrink(("d", d), prior(md, pages), rate)
        k = prior(mh, pages)
        a, b = bad["h", h] + k * rate, n["h", h] - bad["h", h] + k * (1 - rate)
        u, mean, log_beta = (np.arange(200_000) + 0.5) / 200_000, a / (a + b), math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        if a < 1.5:  # x = 0.3 * u ** (1 / a) takes the pole at 0 away
            log = log_beta + a * math.log(0.3) - math.log(a) + (b - 1) * np.log1p(-0.3 * u ** (1 / a))
        else:
            low = max(0.0, mean - 12 * (mean * (1 - mean) / (a + b + 1)) ** 0.5)
            x = low + max(0.3 - low, 1e-12) * u
            log = log_beta + (a - 1) * np.log(x) + (b - 1) * np.log1p(-x) + math.log(max(0.3 - low, 1e-300))
        out[h] = a / (a + b), float(np.exp(log).mean())
    return out


def test_reputation_is_estimated(spark):
    marks = [("a.bad.com", 1)] * 90 + [("a.bad.com", 0)] * 10 + [("b.bad.com", 1)] * 14 + [("b.bad.com", 0)] * 2 + [("b.good.com", 0)] * 60 + [("d.good.com", 0)] * 90 + [("d.good.com", 1)] * 3 + [("e.f.co.uk", 1)] * 40 + [("g.f.co.uk", 1)] * 50 + [("h.i.org", 0)] * 80 + [("few.mid.com", 1), ("few.mid.com", None), ("", 1)]
    outcomes = spark.createDataFrame(marks, "host string, bad int")
    names = ["new.bad.com", "bad.com", "new.good.com", "new.com", "new.f.co.uk", "new.org", "new.dev", "new.mid.com", *{h for h, _ in marks if h}]
    df = spark.createDataFrame([(k, f"http://{h}/x") for k, h in enumerate([*names, ""])], "page_id bigint, url string")
    want = brute_reputation(marks, names)
    got = {r.host: r for r in urlfilter.reputation(outcomes, others=df.select(urlfilter.host_of(F.col("url")).alias("host"))).collect()}
    assert set(got) == set(names)
    for h, (rate, below) in want.items():
        assert abs(got[h].rate - rate) < 1e-9 and abs(got[h].below - below) < 1e-3, h
    verdicts = {r.host: r.verdict for r in urlfilter.judge(df, outcomes, {"page_id": F.col("page_id")}).collect()}
    assert verdicts == {"": "allow"} | {h: "block" if below < 0.01 else "allow" for h, (_, below) in want.items()}
    assert [verdicts[h] for h in ("a.bad.com", "b.bad.com", "new.f.co.uk", "few.mid.com", "b.good.com", "new.good.com", "new.dev")] == ["block", "block", "block", "allow", "allow", "allow", "allow"]
    assert {r.host for r in urlfilter.reputation(outcomes).collect()} == {h for h, _ in marks if h}
    names = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("b.com",), ("com",), ("",)], "h string").select(urlfilter.domain_of(F.col("h")).alias("d"), urlfilter.suffix_of(F.col("h")).alias("s")).collect()
    assert [(n.d, n.s) for n in names] == [("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("b.com", "com"), ("com", "com"), ("", "")]


def test_outcomes(spark):
    rows = [(1, 0, 0), (1, 1, 1), (0, 0, 1), (0, None, 1), (None, 1, 1), (None, 0, None), (1, None, 0), (None, None, None)]
    df = spark.createDataFrame(rows, "q int, t int, want int")
    assert all(r.got == r.want for r in df.select("want", urlfilter.outcome(F.col("q"), F.col("t")).alias("got")).collect())


def test_reputation_decides_both_ways(spark, tmp_path):
    """Hosts of equal names but for a letter: what their documents' labels say decides, through the registered query."""
    labels, pages = [], []
    for k in range(400):
        host = ["quiet-a.one.dev", "quiet-b.one.dev", "quiet-c.two.dev:8080", "me@quiet-d.two.dev"][k % 4]
        pages.append((k, f"https://{host}/xx/{k}", "<p>"))
        labels.append((k, int(k % 4 in (0, 3) or k % 40 == 1), 0 if k % 8 else int(k % 80 == 0)))
    pages += [(1000, "https://casino-win.three.dev/xx/1", "<p>"), (1001, "https://10.0.0.7:80/xx/2", "<p>"), (1002, "https://quiet-c.two.dev/yy", "<p>"), (1003, None, None), (1004, "https://quiet-b.one.dev/" + "z" * 100_000, "")]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.verdict for r in queries.op9_url_filter(spark, str(tmp_path)).collect()}
    assert {got[k] for k in range(400) if k % 4 in (1, 2)} == {"block"} and {got[k] for k in range(400) if k % 4 in (0, 3)} == {"allow"}
    assert (got[1000], got[1002], got[1003], got[1004]) == ("allow", "block", "allow", "block") and len(got) == len(pages)
    names = spark.createDataFrame([("10.0.0.7",), ("[::1]",), ("a.b.example",), ("x.gov.test",)], "h string")
    found = names.select(urlfilter.domain_of(F.col("h"), ["gov.test"]).alias("d"), urlfilter.suffix_of(F.col("h"), ["gov.test"]).alias("s")).collect()
    assert [tuple(r) for r in found] == [("10.0.0.7", "10.0.0.7"), ("[::1]", "[::1]"), ("b.example", "example"), ("x.gov.test", "gov.test")]


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in DATA.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, want))


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_pipeline_is_its_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = []
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, docs, str(DATA))
        assert got.columns == P.COLUMNS, name
        docs = got.checkpoint()
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[0] < 200
    rows = P.run(spark, str(DATA))
    assert {r.doc_id for r in rows.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_empty_texts_stay_in_the_pipeline(spark, tmp_path, monkeypatch):
    import corpus_pipeline as P

    spark.createDataFrame([(1, 0)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "", "en", "s", 0), (2, None, "en", "s", 0), (3, "taken for bad", "en", "s", 13)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    monkeypatch.setattr(P.quality, "fit", lambda *_: P.quality.Model(b"\n" * 16, b"\n" * 16, [-9.0, 0.0, 0.0], 0.5))
    assert {r.doc_id for r in P.quality_classifier(spark, docs, str(tmp_path)).collect()} == {1, 2}
