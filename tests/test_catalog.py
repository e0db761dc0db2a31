"""Every catalog query with SQL against DuckDB on the smallest tables."""

import hashlib
import os
from html.entities import html5

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lakesignal.operators import draws, hypotheses
from lakesignal.operators import statistics as T
from lakesignal.plans import catalog, studies  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    cur = db.execute(catalog.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in cur.fetchall())


def test_names():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_headlines_of_every_slot(spark):
    """Against brute force over a small part of the events."""
    rows = [(r.event_type, int(r.t) // 900 * 900, f"{r.event_id:012d}") for r in spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_type", "event_id", "unix_seconds(cast(ts AS timestamp)) AS t").collect()]
    want = {}
    for g, t in {r[:2] for r in rows}:
        want[g, t] = " | ".join(x for _, x in sorted((u, x) for h, u, x in rows if h == g and t - 2700 <= u <= t)[:8])
    got = {(r.g, r.t): r.headlines for r in catalog.QUERIES["correlated_headlines"](spark, SF).collect()}
    assert got == want
    assert any(t % 86400 != 43200 for _, t in got)


def test_bootstrap_of_2000_resamples(spark):
    """The limits against a plain bootstrap of 2000 resamples over the same clusters."""
    own = {g: sorted((r.cluster, r.num, r.den) for r in catalog.QUERIES["cluster_sums"](spark, SF).collect() if r.group == g) for g in ("ASIA", "EUROPE")}

    def ratio(g, b):
        drawn = [own[g][int(hashlib.md5(f"{b}:{k}:{g}".encode()).hexdigest()[:8], 16) % len(own[g])] for k in range(len(own[g]))]
        return sum(x[1] for x in drawn) / sum(x[2] for x in drawn)

    want = np.percentile([ratio("ASIA", b) - ratio("EUROPE", b) for b in range(2000)], [2.5, 97.5])
    got = catalog.QUERIES["bootstrap_ci"](spark, SF).first()
    assert np.allclose([got.low, got.high], want, atol=1e-6)
    verdict = catalog.QUERIES["equivalence_verdict"](spark, SF).first()
    assert (verdict.above, verdict.below) == (got.low > 0, got.high < 0)


def test_full_bootstrap_sql_draws_every_cluster(db):
    """Over 1,000 clusters a group, each resample draws as many as there are."""
    sql = catalog.BOOT.replace(catalog.CLUSTERS, "SELECT * FROM made")
    db.execute("CREATE TEMP TABLE made AS SELECT g AS \"group\", c AS cluster, 1 AS num, 2 AS den FROM (VALUES ('ASIA'), ('EUROPE')) g(g), range(1200) c(c)")
    drawn = db.execute(sql.replace("range(2000) b(b)", "range(2) b(b)") + " SELECT \"group\", b, count(*) FROM draws GROUP BY ALL").fetchall()
    assert len(drawn) == 4 and {n for _, _, n in drawn} == {1200}


def test_series_compare_sees_a_wrong_stream(spark, monkeypatch):
    """A message that the stream counts elsewhere differs in its cell and nowhere else."""
    read = catalog.monitor.read_messages
    other = spark.read.parquet(f"{SF}/events.parquet").agg({"event_id": "min"}).first()[0]
    monkeypatch.setattr(catalog.monitor, "read_messages", lambda s, p: read(s, p).selectExpr("* EXCEPT (`group`)", f"if(id = '{other}', 'elsewhere', `group`) AS `group`"))
    rows = catalog.QUERIES["series_compare"](spark, SF).where("differ").collect()
    assert len(rows) == 1 and rows[0].in_batch - rows[0].in_stream == 1


def operators_of(plan):
    """Name, output rows and broadcast bytes of every operator that ran."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from operators_of(plan.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from operators_of(plan.plan())
    else:
        metrics = plan.metrics()
        value = lambda m: metrics.apply(m).value() if metrics.contains(m) else 0
        yield name, value("numOutputRows"), value("dataSize") if name.startswith("BroadcastExchange") else 0
        children = plan.children()
        for i in range(children.size()):
            yield from operators_of(children.apply(i))


@pytest.mark.parametrize("name", ["attention_differences", "tone_differences", "bootstrap_ci", "attention_accepted", "framing_verdict", "tone_differences_security"])
def test_draws_are_rows_nowhere(spark, name):
    """Draws that were rows went to the driver in a broadcast of gigabytes."""
    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.01")
    df.collect()
    ran = list(operators_of(df._jdf.queryExecution().executedPlan()))
    assert sum(n for x, n, _ in ran if x == "GenerateExec") < 20_000  # 80,000 draws at least
    assert max(b for _, _, b in ran) < 20 << 20  # one page of a hashed table is 16 MB


@pytest.mark.parametrize("group", ["ASIA", "", "view (translated)", "x" * 48, "ü" * 70])
def test_draws_in_arrays(group):
    """Against the digests themselves: names over a block, numbers of all lengths, several tiles."""
    for n, first, end in ((1, 0, 12), (11, 95, 130), (1234, 1990, 2000), (40_000, 9, 11)):
        got = {b: [] for b in range(first, end)}
        for bs, drawn in draws.tiles(first, end, n, group):
            for b, row in zip(bs, drawn, strict=True):
                got[b].extend(row.tolist())
        for b in (first, end - 1):
            assert got[b] == [int(hashlib.md5(f"{b}:{k}:{group}".encode()).hexdigest()[:8], 16) % n for k in range(n)]
        assert {len(x) for x in got.values()} == {n}


def test_draws_of_several_tables():
    """Tables of fewer and more clusters from the same digests, against each by itself."""
    tables = [[pa.array([None if i % 7 == 0 else i * x for i in range(n)], pa.float64()) for x in (1.5, 0.25)] for n in (300, 7, 1200)]
    for first, end in ((0, 12), (95, 104)):
        assert draws.sums(first, end, "click", tables) == [draws.sums(first, end, "click", [x])[0] for x in tables]


def test_framing_makes_its_draws_once(spark):
    """Both studies at once and without a job of their own: each made its draws before."""
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    df = catalog.QUERIES["framing_verdict"](spark, "/root/testdata/sf0.01")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before
    df.collect()
    assert [x for x, _, _ in operators_of(df._jdf.queryExecution().executedPlan())].count("FlatMapGroupsInArrowExec") == 1
    assert jobs <= 1  # Spark's own, for the table's schema


@pytest.mark.parametrize("name", ["tone_differences", "tone_differences_security"])
def test_tones_read_the_events_once(spark, name):
    """The groups' names were asked for in a pass of their own, cached for nothing."""
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    catalog.QUERIES[name](spark, SF)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before <= 1  # Spark's own, for the table's schema


def test_framing_of_one_side(spark):
    """No security stories, or no reference: as the rules over no intervals have it."""
    rows = [(g, f"d{i}", "en", g != "ru_by" and i % 5 + 5.0 or float(i % 3), True, False) for g in ("ru_by", "baltic_rus") for i in range(20)]
    articles = spark.createDataFrame(rows, "`group` string, domain string, feed string, tone double, about_baltic boolean, security boolean")
    assert tuple(hypotheses.framing(articles, resamples=50).first()) == (True, "different")
    assert tuple(hypotheses.framing(articles.where("`group` = 'ru_by'"), resamples=50).first()) == (None, "different")


def test_bootstrap_of_odd_clusters(spark):
    """Null numerators, few resamples, names in two blocks, and a group that is missing."""
    long = "g" * 60
    own = {g: [(f"c{i:03d}", None if i % 3 == 0 else i + len(g) / 10, 1.0 + i % 4) for i in range(25)] for g in ("a", long)}
    rows = [(g, c, num, den) for g, own_rows in own.items() for c, num, den in own_rows]
    table = spark.createDataFrame(rows, "`group` string, cluster string, num double, den double")

    def ratio(g, b):
        drawn = [own[g][int(hashlib.md5(f"{b}:{k}:{g}".encode()).hexdigest()[:8], 16) % 25] for k in range(25)]
        return sum(x[1] or 0 for x in drawn) / sum(x[2] for x in drawn)

    got = T.ratio_differences(table, "a", (long, "none"), resamples=7).collect()
    assert [r.reference for r in got] == [long]
    assert np.allclose([got[0].low, got[0].high], np.percentile([ratio("a", b) - ratio(long, b) for b in range(7)], [2.5, 97.5]))
    assert T.ratio_differences(table, "none", ("a",), resamples=7).collect() == []


def test_titles_with_other_entities_and_ends(spark, tmp_path):
    """Against the SQL: entities it leaves, cut ones, each kind of space, no title, null."""
    inner = ["A &amp; B", "&quot;x&quot; &lt;b&gt; &#39;", "cut &amp", "&amp;lt; &amp;amp;", " \t x \n ", "\u00a0\u3000x\u2003 \u202f", "\u2028x\u200b", "a\nb", "", "   ", "Stra\u00dfe&nbsp;", "<title>y"]
    pages = [(i, f"<html><title>{x}</title><title>z</title>") for i, x in enumerate(inner)] + [(100, "no title"), (101, None), (102, "<title>open")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = con.execute(catalog.ORACLES["page_title"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["page_title"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) == len(pages)


def test_titles_with_all_entities_resolved(spark, tmp_path):
    """Named, numeric and cut entities, each once, then all white space at the ends; the SQL gives the same."""
    want = {
        "&lt;b&gt; &quot;x&quot; &#39;y&#x27;": "<b> \"x\" 'y'", "Ly.&amp;&amp;&amp; and&amp": "Ly.&&& and&", "&amp;lt; &amp;amp;": "&lt; &amp;", "&notin; &notit; &nope; &#; &": "∉ ¬it; &nope; &#; &",
        "&#128; &#0; &#xD800; &#1;|": "€ � � |", " \t\n&nbsp;x &#10;": "x", "a\nb": "a\nb", "&NotEqualTilde;": "≂̸", "&#" + "9" * 5000 + ";": "�", "&#" + "0" * 5000 + "65;": "A", "": "",
    }
    titles = [*want, *(f"&{n}." for n in html5), *(f"&#{n};." for n in range(300))]
    pages = [(i, f"<html><title>{x}</title>") for i, x in enumerate(titles)] + [(-1, "no title"), (-2, None)]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        sql = con.execute(catalog.ORACLES["page_title"]).fetchall()
    got = {r.page_id: r.title for r in catalog.QUERIES["page_title"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values()) and (got[-1], got[-2]) == ("", None)
    assert len(sql) == len(pages) and dict(sql) == got
