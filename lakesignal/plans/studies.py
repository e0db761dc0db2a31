"""The studies as queries: hypotheses, matching, blind evaluation, report frames
and checks over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesignal.functions import slots as S
from lakesignal.operators import checks, evaluation, hypotheses, lake, matching, reports, spikes
from lakesignal.operators import statistics as T
from lakesignal.plans.catalog import DENSE, ROLLED, SLOT, boot, closed, counts, dense, events, query, seasonal, t
from lakesignal.sources import archive, feeds

# --- events as articles: type is the group, user the source, value the tone ---

ARTICLES = "SELECT event_type AS \"group\", user_id AS domain, CASE WHEN user_id % 2 = 0 THEN 'tr' ELSE 'en' END AS feed, value AS tone, value > 10 AS about, hour(ts) < 12 AS security, CAST(ts AS DATE) AS dt FROM events"
SIDES = f"SELECT CASE WHEN \"group\" = 'click' THEN 'click' WHEN \"group\" = 'view' AND feed = 'tr' THEN 'view (translated)' WHEN \"group\" = 'signup' THEN 'signup' END AS \"group\", domain, tone, security FROM ({ARTICLES}) WHERE about AND tone IS NOT NULL"
BY_DAY = f"SELECT \"group\", domain AS cluster, count(*) FILTER (WHERE about)::DOUBLE AS num, count(*)::DOUBLE AS den FROM ({ARTICLES}) GROUP BY ALL"
TEN = boot(BY_DAY, "click", ("error", "view"))


def toned(security: bool) -> str:
    return boot(f"SELECT \"group\", domain AS cluster, sum(tone) AS num, count(*)::DOUBLE AS den FROM ({SIDES}) WHERE \"group\" IS NOT NULL AND security = {security} GROUP BY ALL", "click", ("signup", "view (translated)"))


def articles(spark, d) -> DataFrame:
    rows = t(spark, d, "events", "event_type", "user_id", "value", "ts")
    return rows.select(F.col("event_type").alias("group"), F.col("user_id").alias("domain"), F.when(F.col("user_id") % 2 == 0, "tr").otherwise("en").alias("feed"), F.col("value").alias("tone"), (F.col("value") > 10).alias("about_baltic"), (F.hour("ts") < 12).alias("security"), F.to_date("ts").alias("dt"))


def by_day(spark, d) -> DataFrame:
    return lake.domain_day(articles(spark, d))


def named():
    return F.when((F.col("group") == "view") & (F.col("feed") == "tr"), "view (translated)").when(F.col("group") == "signup", "signup")


def rounded(df: DataFrame) -> DataFrame:
    return df.select("reference", *[F.round(c, 7).alias(c) for c in ("value", "low", "high")])


CI = "SELECT reference, round(value, 7) AS value, round(low, 7) AS low, round(high, 7) AS high FROM ci"


@query(f"SELECT \"group\", sum(num)::BIGINT AS n_about, sum(den)::BIGINT AS n_rows, count(*)::BIGINT AS domains, round(sum(num) / sum(den), 8) AS share FROM ({BY_DAY}) GROUP BY ALL")
def attention_shares(spark, d):
    return hypotheses.shares(by_day(spark, d)).withColumn("share", F.round("share", 8))


@query(f"{TEN} {CI}")
def attention_differences(spark, d):
    return rounded(hypotheses.attention(by_day(spark, d), "click", ("error", "view")))


@query(f"{TEN} SELECT bool_and(low > 0) AS accepted FROM ci")
def attention_accepted(spark, d):
    return hypotheses.attention_accepted(by_day(spark, d), one="click", others=("error", "view"))


@query(f"{toned(False)} {CI}")
def tone_differences(spark, d):
    return rounded(hypotheses.tone_differences(articles(spark, d), False, "click", named()))


@query(f"{toned(True)} {CI}")
def tone_differences_security(spark, d):
    return rounded(hypotheses.tone_differences(articles(spark, d), True, "click", named()))


@query(f"WITH a AS ({toned(False)} SELECT bool_and(high < 0) AS lower_accepted FROM ci), b AS ({toned(True)} SELECT CASE WHEN bool_and(low > -0.5 AND high < 0.5) THEN 'same within the margin' WHEN bool_and(low <= 0 AND high >= 0) THEN 'no detectable difference' ELSE 'different' END AS verdict FROM ci) SELECT * FROM a, b")
def framing_verdict(spark, d):
    return hypotheses.framing(articles(spark, d), one="click", named=named())


@query(f"SELECT \"group\", round(avg(tone) FILTER (WHERE NOT security), 6) AS other_stories, round(avg(tone) FILTER (WHERE security), 6) AS security FROM ({ARTICLES}) WHERE about GROUP BY ALL")
def tone_by_group(spark, d):
    return hypotheses.mean_tone(articles(spark, d)).select("group", F.round("other_stories", 6).alias("other_stories"), F.round("security", 6).alias("security"))


@query(f"SELECT \"group\", round(100 * sum(num) / sum(den), 6) AS percent FROM ({BY_DAY}) WHERE \"group\" IN ('click', 'error', 'view') GROUP BY ALL")
def attention_frame(spark, d):
    return reports.attention_frame(by_day(spark, d), ("click", "error", "view")).withColumn("percent", F.round("percent", 6))


@query(f"SELECT count(*)::BIGINT AS \"rows\", count(*) FILTER (WHERE about)::BIGINT AS relevant FROM ({ARTICLES})")
def lake_totals(spark, d):
    return lake.totals(by_day(spark, d), articles(spark, d).where("about_baltic"))


@query(f"SELECT strftime(dt, '%Y%m%d') AS day, count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE about)::BIGINT AS relevant FROM ({ARTICLES}) GROUP BY ALL")
def lake_days(spark, d):
    return checks.lake_days(by_day(spark, d), articles(spark, d).where("about_baltic"))


# --- documents as titled articles: matching ----------------------------------

LETTERS = "abcdefghijklmnopqrstuvwxyz"
TITLED = """SELECT doc_id AS id, doc_id * 900 AS t, left(text, 60) AS title, source AS domain, lang, list_distinct(['p:' || x FOR x IN regexp_split_to_array(left(text, 60), '[ \\t\\n\\r]+') IF len(x) > 5] || ['o:' || source]) AS e FROM documents WHERE length(left(text, 60)) > 15"""
COUNTED = "list_transform(string_split('" + LETTERS + "', ''), lambda c: (length(lower(title)) - length(replace(lower(title), c, '')))::DOUBLE)"
PAIRED = f"""WITH x AS ({TITLED}), v AS (SELECT *, {COUNTED} AS w FROM x), u AS (SELECT *, CASE WHEN list_inner_product(w, w) > 0 THEN list_transform(w, lambda y: round(y / sqrt(list_inner_product(w, w)), 5)) ELSE w END AS vec FROM v),
s AS (SELECT * FROM u WHERE lang = 'fr'), o AS (SELECT * FROM u WHERE lang IN ('en', 'de')),
c AS (SELECT s.id AS src_id, o.title AS emb_title, o.domain AS emb_domain, list_inner_product(s.vec, o.vec) AS cos, row_number() OVER (PARTITION BY s.id ORDER BY list_inner_product(s.vec, o.vec) DESC, o.t) AS n FROM s JOIN o ON abs(s.t - o.t) <= 172800),
k AS (SELECT id, t, lang, unnest(e) AS e FROM u WHERE lang IN ('fr', 'en', 'de')), f AS (SELECT e FROM k GROUP BY e HAVING count(*) < 0.03 * (SELECT count(*) FROM u WHERE lang IN ('fr', 'en', 'de'))), r AS (SELECT k.* FROM k JOIN f USING (e)),
p AS (SELECT a.id AS src_id, b.id AS dst_id, count(*) AS shared, min(b.t) AS t FROM r a JOIN r b ON a.e = b.e AND a.lang = 'fr' AND b.lang <> 'fr' AND abs(a.t - b.t) <= 172800 GROUP BY ALL HAVING count(*) >= 2),
q AS (SELECT p.*, row_number() OVER (PARTITION BY src_id ORDER BY shared DESC, t) AS n FROM p),
pairs AS (SELECT s.id AS src_id, s.domain AS src_domain, s.title AS src_title, round(coalesce(c.cos, -1), 4) AS emb_cos, c.emb_title, c.emb_domain, coalesce(q.shared, 0)::INTEGER AS ent_shared, o.title AS ent_title, o.domain AS ent_domain
FROM s LEFT JOIN c ON c.src_id = s.id AND c.n = 1 LEFT JOIN q ON q.src_id = s.id AND q.n = 1 LEFT JOIN o ON o.id = q.dst_id)"""


def letters(c):
    """Counts of the letters a to z: a plain encoder of titles."""
    low = F.lower(c)
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))).cast("double") for x in LETTERS])


def titled(spark, d) -> DataFrame:
    title = F.left("text", F.lit(60))
    long = F.filter(F.split(title, "[ \t\n\r]+"), lambda x: F.length(x) > 5)
    stamp = F.date_format(F.timestamp_seconds(F.col("doc_id") * 900), S.STAMP)
    return t(spark, d, "documents", "doc_id", "text", "lang", "source").select(F.col("doc_id").alias("id"), stamp.alias("ts"), title.alias("title"), F.col("source").alias("domain"), F.col("lang").alias("group"), long.alias("persons"), F.array("source").alias("orgs"), F.lit(True).alias("about_baltic"))


def pairs_of(spark, d) -> DataFrame:
    return matching.match(*matching.sides(titled(spark, d), "fr", ("en", "de")), letters)


@query(f"{PAIRED} SELECT * FROM pairs")
def match_pairs(spark, d):
    return pairs_of(spark, d)


@query(f"{PAIRED} SELECT count(*)::BIGINT AS pairs, round(avg((emb_cos >= 0.7)::INTEGER), 8) AS share_cos, round(avg((ent_shared >= 2)::INTEGER), 8) AS share_ent FROM pairs")
def match_summary(spark, d):
    return evaluation.match_summary(pairs_of(spark, d)).select("pairs", F.round("share_cos", 8).alias("share_cos"), F.round("share_ent", 8).alias("share_ent"))


STRATA = f"""{PAIRED}, g AS (SELECT *, row_number() OVER (ORDER BY emb_cos DESC, src_id) AS n FROM pairs WHERE emb_cos >= 0),
strata AS (SELECT 'emb_top' AS stratum, src_id, src_title, emb_title AS dst_title FROM g WHERE n <= (SELECT count(*) FROM pairs WHERE ent_shared >= 2)
UNION ALL SELECT 'emb_high', src_id, src_title, emb_title FROM g WHERE emb_cos >= 0.7 UNION ALL SELECT 'emb_mid', src_id, src_title, emb_title FROM g WHERE emb_cos >= 0.5 AND emb_cos < 0.7 UNION ALL SELECT 'ent', src_id, src_title, ent_title FROM pairs WHERE ent_shared >= 2)"""


@query(f"{STRATA} SELECT * FROM strata")
def pair_strata(spark, d):
    return evaluation.strata(pairs_of(spark, d))


SHEET = f"""{STRATA}, h AS (SELECT *, md5('7:' || coalesce(src_title, '') || ':' || coalesce(dst_title, '')) AS m FROM strata), w AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('7:' || src_id), src_id) AS r FROM h),
drawn AS (SELECT * FROM w WHERE r <= 30), items AS (SELECT DISTINCT src_title, dst_title, m FROM drawn), sheet AS (SELECT row_number() OVER (ORDER BY m, src_title, dst_title)::INTEGER AS item, src_title, dst_title FROM items)"""


@query(f"{SHEET} SELECT *, '' AS label FROM sheet")
def pair_sheet(spark, d):
    return evaluation.pair_sheet(pairs_of(spark, d))[0]


@query(f"{SHEET} SELECT stratum, src_id, drawn.src_title, drawn.dst_title, item FROM drawn JOIN sheet ON drawn.src_title IS NOT DISTINCT FROM sheet.src_title AND drawn.dst_title IS NOT DISTINCT FROM sheet.dst_title")
def pair_key(spark, d):
    return evaluation.pair_sheet(pairs_of(spark, d))[1]


@query(f"""{SHEET}, done AS (SELECT stratum, CASE WHEN item % 3 = 0 THEN 1 WHEN item % 3 = 1 THEN 0 END AS y FROM drawn JOIN sheet ON drawn.src_title IS NOT DISTINCT FROM sheet.src_title AND drawn.dst_title IS NOT DISTINCT FROM sheet.dst_title)
SELECT stratum, sum(y)::BIGINT AS k, count(*)::BIGINT AS n, round(avg(y), 8) AS value FROM done WHERE y IS NOT NULL GROUP BY ALL""")
def sheet_precision(spark, d):
    """The sheet labelled by item number: yes, no and not sure in turn."""
    sheet, key = evaluation.pair_sheet(pairs_of(spark, d))
    label = F.when(F.col("item") % 3 == 0, " Yes").when(F.col("item") % 3 == 1, "n").otherwise("not sure")
    return evaluation.scored(sheet.withColumn("label", label), key, "stratum").select("stratum", "k", "n", F.round("value", 8).alias("value"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(['p:' || x FOR x IN regexp_split_to_array(left(text, 60), '[ \\t\\n\\r]+') IF len(x) > 5] || ['o:' || source])), ' ') AS entities FROM documents")
def tagged_entities(spark, d):
    rows = titled(spark, d)
    return rows.select(F.col("id").alias("doc_id"), F.array_join(F.array_sort(matching.tagged_entities(F.col("persons"), F.col("orgs"))), " ").alias("entities"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), u AS (SELECT vec_id, x, list_transform(x, lambda y: round(y / sqrt(list_inner_product(x, x)), 5)) AS n FROM v)
SELECT vec_id, len(n)::INTEGER AS dim, round(list_inner_product(n, n), 3) AS squared, round(list_inner_product(n, x) / sqrt(list_inner_product(x, x)), 3) AS cosine FROM u""")
def normalised_vectors(spark, d):
    """Length and direction of the rounded unit vectors (a fifth decimal may round either way)."""
    rows = t(spark, d, "embeddings", "vec_id", "embedding").withColumn("n", matching.normalised(F.col("embedding")))
    square = lambda a, b: matching.dot(F.col(a), F.col(b))
    return rows.select("vec_id", F.size("n").alias("dim"), F.round(square("n", "n"), 3).alias("squared"), F.round(square("n", "embedding") / F.sqrt(square("embedding", "embedding")), 3).alias("cosine"))


@query(f"SELECT DISTINCT strftime({SLOT}, '%Y%m%d%H%M%S') AS slot, CASE WHEN event_type = 'view' THEN 'tr' ELSE 'en' END AS feed, 'https://files.example/' || strftime({SLOT}, '%Y%m%d%H%M%S') || CASE WHEN event_type = 'view' THEN '.translation' ELSE '' END || '.gkg.csv.zip' AS url, strftime({SLOT}, '%Y%m%d%H%M%S') AS parsed_slot, CASE WHEN event_type = 'view' THEN 'tr' ELSE 'en' END AS parsed_feed FROM events")
def file_names(spark, d):
    """Addresses of the files of every slot, and what their names say."""
    rows = events(spark, d).select(S.to_stamp(F.col("ts").cast("timestamp")).alias("slot"), F.when(F.col("event_type") == "view", "tr").otherwise("en").alias("feed")).distinct()
    named = rows.withColumn("url", feeds.url_of("https://files.example/", F.col("feed"), F.col("slot")))
    return named.withColumn("parsed_slot", feeds.slot_of_name(F.col("url"))).withColumn("parsed_feed", feeds.feed_of_name(F.col("url")))


# --- alerts and slots --------------------------------------------------------

ALERTS = f"""{ROLLED}, e AS (SELECT *, lag(score >= 2 AND observed >= 3, 1, false) OVER (PARTITION BY event_type ORDER BY ts) AS was FROM z),
alerts AS (SELECT event_type, ts, score FROM e WHERE score >= 2 AND observed >= 3 AND NOT was), hours AS (SELECT r.ts, r.event_type, r.observed AS "count", alerts.ts IS NOT NULL AS alert FROM r LEFT JOIN alerts ON alerts.ts = r.ts AND alerts.event_type = r.event_type)"""


def alerts(spark, d) -> DataFrame:
    return spikes.alerts(spikes.scores(seasonal(spark, d), 2.0, 3), "ts", "event_type").select("event_type", F.col("ts").alias("slot"), "score")


@query(f"{ALERTS} SELECT * FROM hours")
def alert_hours(spark, d):
    return evaluation.hours(dense(spark, d), alerts(spark, d), group="event_type")


@query(f"{ALERTS} SELECT event_type, ts AS slot, round(score, 6) AS score FROM alerts ORDER BY alerts.score DESC, ts, event_type LIMIT 10")
def strongest_alerts(spark, d):
    return evaluation.strongest(alerts(spark, d), 10, "event_type").withColumn("score", F.round("score", 6))


@query(f"""{ALERTS}, top AS (SELECT event_type, ts FROM alerts ORDER BY score DESC, ts, event_type LIMIT 10), calm AS (SELECT * FROM hours WHERE NOT alert AND "count" >= 4 ORDER BY md5('7:' || ts::VARCHAR || ':' || event_type), ts, event_type LIMIT 10)
SELECT hours.* FROM hours JOIN top USING (ts, event_type) UNION ALL SELECT * FROM calm""")
def evaluated_slots(spark, d):
    return evaluation.slot_items(dense(spark, d), alerts(spark, d), 10, 4, group="event_type")


@query(f"{ALERTS} SELECT event_type, count(*)::BIGINT AS alerts FROM alerts GROUP BY ALL")
def alert_counts(spark, d):
    return reports.alert_counts(alerts(spark, d), "event_type")


@query(f"{ALERTS} SELECT ts, event_type, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts) >= 4 THEN \"count\" END AS observed, alert FROM hours")
def detector_frame(spark, d):
    return reports.detector_frame(dense(spark, d), alerts(spark, d), group="event_type")


LIVE = f"SELECT strftime({SLOT}, '%Y%m%d%H%M%S') AS slot, epoch({SLOT}) + 900 AS e, count(*)::BIGINT AS \"rows\", count(*) FILTER (WHERE event_type = 'error')::BIGINT AS about, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL"


@query(f"""WITH s AS ({LIVE}), w AS (SELECT count(*)::BIGINT AS slots, min(slot) AS first, max(slot) AS last, quantile_cont("rows", 0.5) AS rows_per_slot, quantile_cont(about, 0.5) AS about_per_slot FROM s),
c AS (SELECT count(*)::BIGINT AS steady_slots, round(quantile_cont(20 * hi - lo, 0.5), 4) AS lag_p50_s, round(quantile_cont(20 * hi - lo, 0.95), 4) AS lag_p95_s FROM s WHERE 20 * hi < 3600) SELECT * FROM w, c""")
def live_summary(spark, d):
    """Slots whose marker came after the least value, and that closed after 20 times the greatest."""
    rows = events(spark, d, "value").withColumn("slot", S.to_stamp(F.col("ts").cast("timestamp")))
    end = F.unix_seconds(F.first("ts").cast("timestamp")) + 900
    slots = rows.groupBy("slot").agg(F.count("*").alias("rows"), F.count_if(F.col("event_type") == "error").alias("about"), (end + F.min("value")).alias("sent_at"), (end + 20 * F.max("value")).alias("closed_at"))
    return reports.live(slots).withColumn("lag_p50_s", F.round("lag_p50_s", 4)).withColumn("lag_p95_s", F.round("lag_p95_s", 4))


@query(f"""{DENSE} SELECT (SELECT count(DISTINCT ts) FROM c)::BIGINT AS slots, 0::BIGINT AS duplicates, (SELECT count(*) FROM s WHERE ts NOT IN (SELECT ts FROM c))::BIGINT AS missing, 0::BIGINT AS differ, (SELECT sum("count") FROM c)::BIGINT AS security_stream, (SELECT sum("count") FROM c)::BIGINT AS security_batch, (SELECT count(*) FROM s WHERE ts NOT IN (SELECT ts FROM c)) = 0 AS ok""")
def stream_agreement(spark, d):
    """Totals of the stateful stream's slots against the batch series."""
    series = counts(spark, d).select(S.to_stamp(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("group"), "count")
    ends = series.agg(F.min("ts").alias("a"), F.max("ts").alias("z")).first()
    return checks.agreement(closed(spark, d, F.lit(True)), series, ends.a, ends.z)


@query("""WITH b AS (SELECT o_orderpriority AS engine, o_orderkey % 4 + 1 AS workers, quantile_cont(o_totalprice, 0.5) AS med, min(o_totalprice) AS lo FROM orders GROUP BY ALL)
SELECT (SELECT med FROM b WHERE engine = '1-URGENT' AND workers = 4) < (SELECT lo FROM b WHERE engine = '2-HIGH' AND workers = 4) AS beats""")
def scaling_rule(spark, d):
    runs = t(spark, d, "orders", "o_orderpriority", "o_orderkey", "o_totalprice").select(F.col("o_orderpriority").alias("engine"), (F.col("o_orderkey") % 4 + 1).alias("workers"), F.col("o_totalprice").alias("wall_s"))
    return T.beats(T.scaling(runs, ("engine",)), "1-URGENT", "2-HIGH")


@query("""WITH c AS (SELECT DISTINCT o_orderpriority AS engine, o_orderkey % 7 AS days, o_custkey % 9 + 1 AS workers FROM orders), w AS (SELECT engine, days, workers, unnest(range(1, 4)) AS repeat FROM c WHERE workers <= 6)
SELECT engine, days::BIGINT AS days, workers::BIGINT AS workers, repeat::INTEGER AS repeat FROM w WHERE NOT (repeat = 1 AND days < 3)""")
def pending_runs(spark, d):
    """Runs still to do if the first repeats on under three days are done."""
    configs = t(spark, d, "orders", "o_orderpriority", "o_orderkey", "o_custkey").select(F.col("o_orderpriority").alias("engine"), (F.col("o_orderkey") % 7).alias("days"), (F.col("o_custkey") % 9 + 1).alias("workers"))
    done = configs.distinct().where("days < 3").withColumn("repeat", F.lit(1))
    return archive.pending(spark, configs, done, 6)


THEMES3 = """WITH x AS (SELECT lang, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+')) AS theme FROM documents), n AS (SELECT lang, theme, count(*) AS n FROM x WHERE theme <> '' GROUP BY ALL),
w AS (SELECT theme, coalesce(sum(n) FILTER (WHERE lang = 'en'), 0) AS en, coalesce(sum(n) FILTER (WHERE lang = 'de'), 0) AS de, coalesce(sum(n) FILTER (WHERE lang = 'fr'), 0) AS fr FROM n GROUP BY theme),
l AS (SELECT theme, ln((en / (SELECT sum(n) FROM n WHERE lang = 'en')) / (de / (SELECT sum(n) FROM n WHERE lang = 'de'))) AS r FROM w WHERE en >= 3 AND de >= 3 AND fr >= 3 AND NOT starts_with(theme, 'x') AND NOT starts_with(theme, 'q')),
z AS (SELECT *, row_number() OVER (ORDER BY r, theme) AS up, row_number() OVER (ORDER BY r DESC, theme DESC) AS down FROM l)"""


@query(f"{THEMES3} SELECT theme, left(theme, 40) AS label, round(r, 6) AS log_ratio FROM z WHERE up <= 8 OR down <= 8")
def theme_frame(spark, d):
    rows = t(spark, d, "documents", "lang", "text").select(F.col("lang").alias("group"), F.split(F.lower("text"), "[ \t\n\r]+").alias("token"))
    got = reports.theme_ratios(lake.theme_group(rows, "token").where("theme <> ''"), "en", "de", 3, ("fr",), ("x", "q"))
    return reports.both_ends(got.select("theme", F.col("log_ratio").alias("r")), "r", "theme", 8).select("theme", F.left("theme", F.lit(40)).alias("label"), F.round("r", 6).alias("log_ratio"))


