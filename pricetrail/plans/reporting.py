"""Registered queries over evaluation, match runs, images and archived pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import literal_list
from ..operators import images, pages, reports, runs
from ..session import shared_path, spread
from ..sources import rate_pages, records
from .views import table, utc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


# --- evaluation -------------------------------------------------------------------------------


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with ``labels`` as judged pairs: gold from quality, prediction from the text's size."""
    gold = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(gold, "doc_id", "left").select(
        F.col("doc_id").alias("sample_id"), (F.col("doc_id") % 40).alias("group_id"),
        F.element_at(literal_list(list(reports.SPLITS)), ((F.col("doc_id") % 40) % 5 + F.when(F.col("doc_id") % 97 == 0, 1).otherwise(0)).cast("int") % 5 + 1).alias("split"),
        F.when(F.col("quality").isNull(), "uncertain").when(F.col("quality") == 1, "same_product").otherwise("different_product").alias("label"),
        reports.prediction(F.when(F.col("n_chars") % 3 == 0, "auto_match").when(F.col("n_chars") % 3 == 1, "review").otherwise("reject")).alias("prediction"),
        F.col("source").alias("category"), F.col("lang").alias("reference_language"), F.lit("en").alias("candidate_language"),
    )


EXAMPLES_SQL = """
ex AS (SELECT d.doc_id AS sample_id, d.doc_id % 40 AS group_id,
    (['development', 'train', 'calibration', 'validation', 'holdout'])[CAST((d.doc_id % 40 % 5 + CASE WHEN d.doc_id % 97 = 0 THEN 1 ELSE 0 END) % 5 + 1 AS INTEGER)] AS split,
    CASE WHEN quality IS NULL THEN 'uncertain' WHEN quality = 1 THEN 'same_product' ELSE 'different_product' END AS label,
    CASE n_chars % 3 WHEN 0 THEN 'same_product' WHEN 1 THEN 'uncertain' ELSE 'different_product' END AS prediction, source AS category, lang
  FROM documents d LEFT JOIN labels USING (doc_id)),
cm AS (SELECT category, lang, count(*) AS count, count(*) FILTER (label = 'same_product' AND prediction = 'same_product') AS tp,
    count(*) FILTER (label = 'different_product' AND prediction = 'same_product') AS fp, count(*) FILTER (label = 'same_product' AND prediction <> 'same_product') AS fn,
    count(*) FILTER (label = 'different_product' AND prediction <> 'same_product') AS tn FROM ex WHERE label <> 'uncertain' GROUP BY {sets})"""
METRICS_SQL = """count, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 9) AS precision_auto_match, round(tp / nullif(tp + fn, 0), 9) AS recall_same_product,
  round(CASE WHEN tp + fp = 0 OR tp + fn = 0 THEN NULL WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 9) AS f1_same_product,
  round(fp / nullif(fp + tn, 0), 9) AS false_positive_rate"""
SCORES = ("precision_auto_match", "recall_same_product", "f1_same_product", "false_positive_rate")


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in SCORES})


@query("eval_metrics", "WITH " + EXAMPLES_SQL.format(sets="GROUPING SETS ((), (category), (lang))") + f" SELECT {METRICS_SQL} FROM cm WHERE category IS NULL AND lang IS NULL")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.metrics(examples(spark, sf_dir)))


@query(
    "eval_slices",
    "WITH " + EXAMPLES_SQL.format(sets="GROUPING SETS ((), (category), (lang))")
    + f" SELECT CASE WHEN category IS NOT NULL THEN 'category:' || category WHEN lang IS NOT NULL THEN 'language_pair:' || lang || '-en' ELSE 'all' END AS slice, {METRICS_SQL} FROM cm",
)
def eval_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.metric_slices(examples(spark, sf_dir)))


@query(
    "eval_confusion",
    "WITH " + EXAMPLES_SQL.format(sets="category, lang") + """ SELECT label, count(*) FILTER (prediction = 'same_product') AS same_product,
      count(*) FILTER (prediction = 'different_product') AS different_product, count(*) FILTER (prediction = 'uncertain') AS uncertain FROM ex GROUP BY label""",
)
def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.confusion(examples(spark, sf_dir))


@query(
    "split_leakage",
    "WITH " + EXAMPLES_SQL.format(sets="category, lang") + """ SELECT group_id, count(DISTINCT split) AS splits, string_agg(DISTINCT split, ',' ORDER BY split) AS split_names
      FROM ex GROUP BY group_id HAVING count(DISTINCT split) > 1""",
)
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.split_leaks(examples(spark, sf_dir))


@query("sample_duplicates", "SELECT text, count(*) AS rows FROM documents GROUP BY text HAVING count(*) > 1")
def sample_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.duplicates(table(spark, sf_dir, "documents"), ["text"])


def labelled_file(spark: SparkSession, sf_dir: str) -> str:
    """``documents`` with ``labels`` written as a labelled set of JSON lines, some of them with one fault each."""
    gold = table(spark, sf_dir, "labels").select("doc_id", "quality")
    k = F.col("doc_id")
    identity = lambda title, extra: F.struct(title.alias("title"), F.col("source").alias("store"), extra.alias("colour"))
    faulty = lambda every, at: k % every == at
    none = F.lit(None).cast("string")
    group = k % 200
    pair = F.struct(
        F.when(faulty(101, 3), "2").otherwise("1").alias("schema_version"),
        F.when(faulty(89, 5), k - 1).otherwise(k).cast("string").alias("sample_id"),
        F.concat(F.lit("g"), group).alias("group_id"),
        F.when(faulty(103, 7), "other").otherwise(F.element_at(literal_list(list(reports.SPLITS)), ((group + F.when(faulty(97, 0), 1).otherwise(0)) % 5 + 1).cast("int"))).alias("split"),
        F.when(faulty(107, 9), "maybe").when(F.col("quality").isNull(), "uncertain").when(F.col("quality") == 1, "same_product").otherwise("different_product").alias("label"),
        F.col("source").alias("category"), F.when(faulty(83, 2), " ").otherwise(F.col("lang")).alias("reference_language"), F.lit("en").alias("candidate_language"),
        F.when(faulty(109, 11), "guess").when(k % 2 == 0, "synthetic").alias("provenance"), F.when(faulty(113, 13), "x").alias("comment"),
        identity(F.when(~faulty(131, 19), F.col("text")), none).alias("reference"), identity(F.lit("a title"), F.when(faulty(137, 23), "red")).alias("candidate"),
    )
    lines = table(spark, sf_dir, "documents").join(gold, "doc_id", "left").select(F.when(faulty(127, 17), "[broken").otherwise(F.to_json(pair)).alias("value"))
    path = shared_path(spark, "labelled")
    lines.write.text(path)
    return path


@query(
    "labelled_pairs",
    """WITH d AS (SELECT documents.*, quality FROM documents LEFT JOIN labels USING (doc_id)),
    p AS (SELECT CASE WHEN doc_id % 127 <> 17 THEN CAST(CASE WHEN doc_id % 89 = 5 THEN doc_id - 1 ELSE doc_id END AS VARCHAR) END AS sample_id, doc_id % 200 AS group_id,
        CASE WHEN doc_id % 103 = 7 THEN 'other' ELSE (['development', 'train', 'calibration', 'validation', 'holdout'])[
          CAST((doc_id % 200 + CASE WHEN doc_id % 97 = 0 THEN 1 ELSE 0 END) % 5 + 1 AS INTEGER)] END AS split,
        CASE WHEN doc_id % 107 = 9 THEN 'maybe' WHEN quality IS NULL THEN 'uncertain' WHEN quality = 1 THEN 'same_product' ELSE 'different_product' END AS label,
        source AS category, length(text) AS title_chars,
        CASE WHEN doc_id % 127 = 17 THEN 'malformed' WHEN doc_id % 113 = 13 OR doc_id % 137 = 23 THEN 'unknown_field' WHEN doc_id % 101 = 3 THEN 'schema_version'
          WHEN source IS NULL OR trim(source) = '' OR lang IS NULL OR trim(lang) = '' OR doc_id % 83 = 2 THEN 'text_missing' WHEN doc_id % 103 = 7 THEN 'split'
          WHEN doc_id % 107 = 9 THEN 'label' WHEN doc_id % 109 = 11 THEN 'provenance' WHEN text IS NULL OR doc_id % 131 = 19 THEN 'identity' END AS error FROM d),
    good AS (SELECT * FROM p WHERE error IS NULL)
    SELECT sample_id, split, label, category, title_chars, error FROM good
    UNION ALL SELECT sample_id, NULL, NULL, NULL, NULL, error FROM p WHERE error IS NOT NULL
    UNION ALL SELECT sample_id, NULL, NULL, NULL, NULL, 'sample_id_repeated' FROM good GROUP BY sample_id HAVING count(*) > 1
    UNION ALL SELECT sample_id, NULL, NULL, NULL, NULL, 'group_in_two_splits' FROM good
      WHERE group_id IN (SELECT group_id FROM good GROUP BY group_id HAVING count(DISTINCT split) > 1)""",
)
def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, refused = records.labelled_pairs(spark, labelled_file(spark, sf_dir))
    kept = good.select("sample_id", "split", "label", "category", F.length("reference.title").cast("long").alias("title_chars"))
    return kept.unionByName(refused, allowMissingColumns=True)


# --- runs -------------------------------------------------------------------------------------


def store_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as store runs of match runs (``orders``)."""
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("store"),
        F.when(flag == "A", "match").when(flag == "N", "no_match").when(line == "O", "error").otherwise("running").alias("status"),
        (F.col("l_quantity") * 100).cast("long").alias("duration_ms"), (F.col("l_quantity") * 40).cast("long").alias("search_ms"),
        (F.col("l_quantity") * 60).cast("long").alias("fetch_ms"), F.col("l_linenumber").cast("long").alias("fetches"),
        F.to_json(F.struct(F.col("l_partkey").cast("string").alias("title"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))).alias("matched_payload"),
        "l_extendedprice", "l_partkey", "l_linenumber",
    )


RUNS_SQL = """
sr AS (SELECT *, CASE WHEN l_returnflag = 'A' THEN 'match' WHEN l_returnflag = 'N' THEN 'no_match' WHEN l_linestatus = 'O' THEN 'error' ELSE 'running' END AS status,
    CAST(l_quantity AS BIGINT) AS q FROM lineitem),
rn AS (SELECT o_orderkey AS id, o_custkey AS product_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status, o_orderdate AS started_at,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 10 MINUTE END AS claim_expires_at, o_orderkey % 5 AS attempts FROM orders)"""
NOW = "1998-06-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def match_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, at = F.col("o_orderkey"), utc("o_orderdate")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("pending")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), F.col("o_custkey").alias("product_id"), status.alias("status"), at.alias("started_at"),
        F.when(key % 2 == 0, F.timestamp_micros(F.unix_micros(at) + 60_000_000)).alias("claimed_at"),
        F.when(key % 3 == 0, F.timestamp_micros(F.unix_micros(at) + 600_000_000)).alias("claim_expires_at"), (key % 5).alias("attempts"),
        F.concat(F.lit("user-"), (F.col("o_custkey") % 9).cast("string")).alias("requested_by"), F.lit(None).cast("string").alias("failure_code"),
        (key % 4).alias("matches_found"), F.lit(8).cast("long").alias("stores_total"), (key % 3).alias("stores_completed"),
    )


@query(
    "run_rollup",
    "WITH " + RUNS_SQL + """ SELECT l_orderkey AS run_id, count(*) AS stores_total, count(*) FILTER (status <> 'running') AS stores_completed,
      count(*) FILTER (status = 'match') AS matches, count(*) FILTER (status = 'no_match') AS no_matches, count(*) FILTER (status = 'error') AS errors FROM sr GROUP BY 1""",
)
def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_rollup(store_runs(spark, sf_dir))


@query(
    "terminal_stores",
    "WITH " + RUNS_SQL + """ SELECT l_orderkey AS run_id, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS stores FROM sr WHERE status <> 'running' GROUP BY 1""",
)
def terminal_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store_runs(spark, sf_dir).withColumn("store", F.col("store").cast("string"))
    return runs.terminal_stores(rows).select("run_id", F.array_join("stores", ",").alias("stores"))


@query(
    "open_stores",
    "WITH " + RUNS_SQL + """, target AS (SELECT l_orderkey AS run_id, l_suppkey AS store FROM sr UNION SELECT l_orderkey, l_suppkey + 1 FROM sr WHERE l_linenumber = 1)
    SELECT run_id, store FROM target EXCEPT SELECT l_orderkey, l_suppkey FROM sr WHERE status <> 'running'""",
)
def open_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores that a run was to search, one of them perhaps not begun, without those that have ended."""
    rows = store_runs(spark, sf_dir)
    more = rows.where("l_linenumber = 1").select("run_id", (F.col("store") + 1).alias("store"))
    return runs.open_stores(rows.select("run_id", "store").unionByName(more).distinct(), rows)


@query(
    "run_liveness",
    "WITH " + RUNS_SQL + f""" SELECT CASE WHEN status = 'pending' THEN 'active' WHEN status = 'running' THEN CASE WHEN coalesce(claim_expires_at > TIMESTAMP '{NOW}', false) THEN 'active'
      ELSE 'stale' END ELSE status END AS liveness, count(*) AS runs FROM rn GROUP BY 1""",
)
def run_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_runs(spark, sf_dir).groupBy(runs.liveness(now()).alias("liveness")).agg(F.count("*").alias("runs"))


@query(
    "run_backlog",
    "WITH " + RUNS_SQL + f""" SELECT id, epoch_us(started_at) AS started_us FROM rn WHERE status IN ('pending', 'running') AND NOT coalesce(claim_expires_at > TIMESTAMP '{NOW}', false)
      ORDER BY started_at, id LIMIT 100""",
)
def run_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.backlog(match_runs(spark, sf_dir), now(), 100).select("id", F.unix_micros("started_at").alias("started_us"))


@query(
    "active_runs",
    "WITH " + RUNS_SQL + f""" SELECT product_id, id FROM rn WHERE status = 'pending' OR (status = 'running' AND claim_expires_at > TIMESTAMP '{NOW}')
      QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY started_at DESC, id DESC) = 1""",
)
def active_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.active_runs(match_runs(spark, sf_dir), now()).select("product_id", "id")


@query(
    "newest_runs",
    "WITH " + RUNS_SQL + """ SELECT product_id, id FROM rn QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY started_at DESC, id DESC) BETWEEN 3 AND 5""",
)
def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.newest_per(match_runs(spark, sf_dir), "product_id", "started_at", "id", 3, 2).select("product_id", "id")


@query(
    "notifications",
    "WITH " + RUNS_SQL + f""", f AS (SELECT *, greatest(0, epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(CASE WHEN id % 2 = 0 THEN started_at + INTERVAL 1 MINUTE ELSE started_at END)) // 1000 AS s FROM rn
      WHERE status = 'running' AND NOT coalesce(claim_expires_at > TIMESTAMP '{NOW}', false) AND attempts >= 3)
    SELECT f.id AS match_run_id, 'user-' || CAST(product_id % 9 AS VARCHAR) AS user_id, 'PRODUCT_MATCH_FAILED' AS type, c_name || ' — a execução foi interrompida antes da conclusão (worker perdido). Tempo ativo: '
      || printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) || '.' AS message FROM f JOIN customer ON c_custkey = product_id WHERE f.id % 7 <> 0""",
)
def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = runs.fail_exhausted(match_runs(spark, sf_dir), now())
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    made = runs.notifications(failed, owners)
    existing = match_runs(spark, sf_dir).where("id % 7 = 0").select(F.col("id").alias("match_run_id"), F.lit("PRODUCT_MATCH_FAILED").alias("type"))
    return runs.new_notifications(existing, made).select("match_run_id", "user_id", "type", "message")


@query(
    "unread",
    """SELECT 'user-' || CAST(o_custkey % 9 AS VARCHAR) AS user_id, count(*) FILTER (o_orderkey % 2 = 1) AS unread FROM orders GROUP BY 1""",
)
def unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = match_runs(spark, sf_dir).select(F.col("requested_by").alias("user_id"), F.col("claimed_at").alias("read_at"))
    return runs.unread(notes)


@query(
    "finished_runs",
    "WITH " + RUNS_SQL + f""", d AS (SELECT l_orderkey, count(*) FILTER (status <> 'running') AS done FROM sr GROUP BY 1)
    SELECT id, greatest(0, epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(CASE WHEN id % 2 = 0 THEN started_at + INTERVAL 1 MINUTE ELSE started_at END)) AS total_duration_ms,
      greatest(id % 3, coalesce(done, 0)) AS stores_completed FROM rn LEFT JOIN d ON l_orderkey = id""",
)
def finished_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.finish_runs(match_runs(spark, sf_dir), store_runs(spark, sf_dir), now()).select("id", "total_duration_ms", "stores_completed")


@query(
    "live_view",
    "WITH " + RUNS_SQL + f""" SELECT rn.id AS run_id, c_name AS product_title, count(l_orderkey) AS stores, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS price_total,
      bool_or(rn.status = 'pending' OR (rn.status = 'running' AND coalesce(claim_expires_at > TIMESTAMP '{NOW}', false))) AS is_active
    FROM rn JOIN customer ON c_custkey = product_id LEFT JOIN sr ON l_orderkey = rn.id GROUP BY 1, 2""",
)
def live_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    rows = runs.live_view(match_runs(spark, sf_dir), store_runs(spark, sf_dir), owners, now())
    return rows.groupBy("run_id", "product_title").agg(
        F.count("store").alias("stores"), F.sum("matched_price").cast("decimal(38,4)").alias("price_total"), F.bool_or("is_active").alias("is_active")
    )


@query(
    "start_runs",
    "WITH " + RUNS_SQL + f""", act AS (SELECT DISTINCT product_id FROM rn WHERE status = 'pending' OR (status = 'running' AND claim_expires_at > TIMESTAMP '{NOW}'))
    SELECT CASE WHEN c_custkey % 2 = 0 THEN 11 - 1 ELSE 11 END AS seeded, count(*) AS new_runs FROM customer
    WHERE c_custkey NOT IN (SELECT product_id FROM act) GROUP BY 1""",
)
def start_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New runs for idle products and the pending store rows each of them is seeded with."""
    from ..rules.stores import store_table

    key = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(
        key.alias("product_id"), F.lit("user-1").alias("requested_by"), F.lit("https://x").alias("reference_url"),
        F.when(key % 2 == 0, "amazon").otherwise("corner").alias("reference_store"), F.lit("BR").alias("reference_country"), F.lit(0).alias("seq"),
    )
    made, seeds = runs.start_runs(asked, match_runs(spark, sf_dir), store_table(spark), now())
    counts = seeds.groupBy("run_id").agg(F.count("*").alias("seeded"))
    return made.join(counts, made["id"] == counts["run_id"]).groupBy(F.col("seeded").cast("int").alias("seeded")).agg(F.count("*").alias("new_runs"))


# --- durations --------------------------------------------------------------------------------


@query(
    "durations_pct",
    """SELECT l_returnflag AS status, count(*) AS measured, quantile_cont(CAST(l_quantity AS BIGINT) * 100, 0.5) AS p50, quantile_cont(CAST(l_quantity AS BIGINT) * 100, 0.95) AS p95
    FROM lineitem GROUP BY 1""",
)
def durations_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("status"), (F.col("l_quantity").cast("long") * 100).alias("ms"))
    return reports.percentiles(rows, ["status"], "ms")


@query(
    "stage_rollup",
    "WITH " + RUNS_SQL + """ SELECT l_orderkey AS run_id, l_suppkey AS store, CASE grouping(l_orderkey, l_suppkey) WHEN 3 THEN 'all' WHEN 1 THEN 'run' ELSE 'store' END AS level,
      CAST(sum(q * 100) AS BIGINT) AS elapsed_ms, CAST(sum(q * 40) AS BIGINT) AS search_ms, CAST(sum(q * 60) AS BIGINT) AS fetch_ms, CAST(sum(l_linenumber) AS BIGINT) AS fetches,
      count(*) FILTER (status = 'match') AS matched FROM sr GROUP BY ROLLUP (l_orderkey, l_suppkey)""",
)
def stage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.stage_rollup(store_runs(spark, sf_dir))


@query(
    "severity",
    """SELECT cat, sev, count(*) AS operations FROM (SELECT cat, CASE WHEN ms >= c THEN 'CRITICAL' WHEN ms >= s THEN 'SLOW' WHEN ms >= w THEN 'WARN' ELSE 'NORMAL' END AS sev FROM (
      SELECT CASE o_orderkey % 3 WHEN 0 THEN 'database_query' WHEN 1 THEN 'product_match' ELSE 'http_request' END AS cat,
        CASE o_orderkey % 3 WHEN 0 THEN 200 WHEN 1 THEN 30000 ELSE 3000 END AS w, CASE o_orderkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN 180000 ELSE 15000 END AS s,
        CASE o_orderkey % 3 WHEN 0 THEN 5000 WHEN 1 THEN 600000 ELSE 60000 END AS c, floor(o_totalprice) AS ms FROM orders)) GROUP BY 1, 2""",
)
def severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey") % 3
    cat = F.when(key == 0, "database_query").when(key == 1, "product_match").otherwise("http_request")
    rows = table(spark, sf_dir, "orders").select(cat.alias("cat"), F.floor("o_totalprice").alias("ms"))
    return rows.groupBy("cat", reports.severity(F.col("cat"), F.col("ms")).alias("sev")).agg(F.count("*").alias("operations"))


@query(
    "repeated_work",
    """SELECT 'part' AS kind, CAST(l_partkey AS VARCHAR) AS key, count(*) AS times FROM lineitem GROUP BY 2 HAVING count(*) >= 2 ORDER BY times DESC, key LIMIT 20""",
)
def repeated_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "lineitem").select(F.lit("part").alias("kind"), F.col("l_partkey").cast("string").alias("key"))
    return reports.repeated_work(log)


@query(
    "retry_report",
    """SELECT l_orderkey AS operation, count(*) AS attempts, count(*) - 1 AS retries, CAST(sum(CAST(l_quantity AS BIGINT) * 10 + l_linenumber) AS BIGINT) AS total_ms,
      CAST(sum(l_linenumber) AS BIGINT) AS backoff_ms_total, count(*) FILTER (l_returnflag <> 'A') AS failed_attempts FROM lineitem GROUP BY 1""",
)
def retry_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("operation"), F.col("l_linenumber").alias("attempt"), (F.col("l_quantity").cast("long") * 10).alias("duration_ms"),
        F.col("l_linenumber").cast("long").alias("backoff_ms"), F.when(F.col("l_returnflag") == "A", "ok").otherwise("failed").alias("outcome"),
    )
    return reports.retry_report(attempts).drop("last_outcome")


@query(
    "fetch_costs",
    """SELECT l_suppkey AS store, l_linestatus AS stage, count(*) AS fetches, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS bytes,
      CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_ms, count(*) FILTER (l_linenumber % 2 = 0) AS cache_hits, CAST(sum(l_linenumber) AS BIGINT) AS retries,
      quantile_cont(CAST(l_quantity AS BIGINT), 0.95) AS p95 FROM lineitem GROUP BY 1, 2""",
)
def fetch_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("store"), F.col("l_linestatus").alias("stage"), F.floor("l_extendedprice").alias("bytes"),
        F.col("l_quantity").cast("long").alias("duration_ms"), (F.col("l_linenumber") % 2 == 0).alias("cache_hit"), F.col("l_linenumber").alias("retries"),
    )
    return reports.fetch_costs(rows)


# --- images -----------------------------------------------------------------------------------


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as product images: product = order, one image per line."""
    k = F.col("l_partkey") % 7
    pick = lambda *names: F.get(literal_list(list(names)), (k % len(names)).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id"),
        F.col("l_orderkey").alias("product_id"), F.col("l_linenumber").alias("position"), (F.col("l_linenumber") == 3).alias("is_main"),
        pick("ready", "pending", "failed", "downloading").alias("original_status"), pick("ready", "pending", "processing").alias("optimized_status"),
        F.when(k < 5, F.concat(F.lit("f"), (F.col("l_partkey") % 20).cast("string"))).alias("original_file_id"), F.when(k < 4, "o").alias("optimized_file_id"),
        F.lit("https://img").alias("source_url"), utc("l_shipdate").alias("created_at"), utc("l_shipdate").alias("next_attempt_at"),
        F.lit(None).cast("timestamp").alias("claim_expires_at"), F.md5((F.col("l_partkey") % 50).cast("string")).alias("sha256"),
    )


GALLERY_SQL = """
im AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_orderkey AS product_id, l_linenumber AS position, l_linenumber = 3 AS is_main, l_shipdate,
    (['ready', 'pending', 'failed', 'downloading'])[CAST(l_partkey % 7 % 4 AS INTEGER) + 1] AS o, (['ready', 'pending', 'processing'])[CAST(l_partkey % 7 % 3 AS INTEGER) + 1] AS z,
    CASE WHEN l_partkey % 7 < 5 THEN 'f' || CAST(l_partkey % 20 AS VARCHAR) END AS ofile, CASE WHEN l_partkey % 7 < 4 THEN 'o' END AS zfile, l_partkey % 50 AS sha FROM lineitem)"""


@query(
    "image_status",
    "WITH " + GALLERY_SQL + """ SELECT CASE WHEN z = 'ready' AND zfile IS NOT NULL THEN 'ready' WHEN o = 'ready' THEN CASE WHEN ofile IS NOT NULL THEN 'ready' ELSE 'invalid_reference' END
      WHEN o IN ('pending', 'downloading') THEN 'processing' ELSE 'storage_error' END AS image_status, count(*) AS images FROM im GROUP BY 1""",
)
def image_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.with_view(gallery(spark, sf_dir)).groupBy("image_status").agg(F.count("*").alias("images"))


@query(
    "import_status",
    "WITH " + GALLERY_SQL + """, s AS (SELECT product_id, CASE WHEN o = 'failed' OR z = 'failed' THEN 'error' WHEN z = 'ready' THEN 'ready' WHEN o = 'downloading' OR z = 'processing' THEN 'processing' ELSE 'pending' END AS s FROM im)
    SELECT product_id, count(*) AS images, count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'processing') AS processing, count(*) FILTER (s = 'ready') AS ready, count(*) FILTER (s = 'error') AS error FROM s GROUP BY 1""",
)
def import_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.import_status(gallery(spark, sf_dir))


@query(
    "primary_images",
    "WITH " + GALLERY_SQL + """ SELECT product_id, id FROM im QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY NOT is_main, position, l_shipdate, id) = 1""",
)
def primary_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.primary_images(gallery(spark, sf_dir)).select("product_id", "id")


@query(
    "gallery_positions",
    "WITH " + GALLERY_SQL + """, n AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY position, l_shipdate, id) - 1 AS p, max(CAST(is_main AS INTEGER)) OVER (PARTITION BY product_id) AS any_main FROM im)
    SELECT id, product_id, p AS position, is_main OR (any_main = 0 AND p = 0) AS is_main FROM n""",
)
def gallery_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.resequence(gallery(spark, sf_dir)).select("id", "product_id", "position", "is_main")


@query(
    "gallery_audit",
    "WITH " + GALLERY_SQL + """ SELECT product_id, count(*) AS images, count(*) FILTER (is_main) AS mains, count(DISTINCT position) AS positions FROM im GROUP BY 1
      HAVING count(*) FILTER (is_main) <> 1 OR count(DISTINCT position) <> count(*)""",
)
def gallery_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.gallery_audit(gallery(spark, sf_dir))


@query(
    "image_reuse",
    "WITH " + GALLERY_SQL + """ SELECT a.id, min(b.id) <> '' AS reused FROM im a JOIN im b ON a.product_id = b.product_id AND a.ofile = b.ofile AND a.id <> b.id
      WHERE b.z = 'ready' AND b.zfile IS NOT NULL GROUP BY 1""",
)
def image_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.reusable(gallery(spark, sf_dir)).select("id", (F.col("reuse_id") != "").alias("reused"))


@query(
    "image_content",
    "WITH " + GALLERY_SQL + " SELECT product_id, count(DISTINCT sha) AS assets FROM im GROUP BY 1",
)
def image_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.by_content(gallery(spark, sf_dir)).groupBy("product_id").agg(F.count("*").alias("assets"))


@query(
    "image_backlog",
    "WITH " + GALLERY_SQL + f""" SELECT id FROM im WHERE (o IN ('pending', 'downloading') OR (o = 'ready' AND ofile IS NOT NULL))
      AND ((z = 'pending' AND l_shipdate <= TIMESTAMP '{NOW}') OR z = 'processing') ORDER BY l_shipdate, id LIMIT 200""",
)
def image_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.backlog(gallery(spark, sf_dir), now(), 200).select("id")


@query(
    "image_funnel",
    """SELECT l_suppkey AS store, count(*) AS passes, CAST(sum(l_linenumber * 4) AS BIGINT) AS found, CAST(sum(l_linenumber) AS BIGINT) AS returned,
      CAST(sum(l_linenumber * 3) AS BIGINT) AS omitted FROM lineitem GROUP BY 1""",
)
def image_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    passes = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("store"), (n * 4).alias("raw"), (n * 3).alias("after_filter"), (n * 2).alias("after_dedup"), n.alias("returned")
    )
    return images.funnel(passes).select("store", "passes", "found", "returned", "omitted")


# --- pages ------------------------------------------------------------------------------------


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with the marks of block and error pages added to the whole text of some."""
    marks = ["", "<p>Sorry, you have been blocked</p>", '<div id="sec-if-cpt-container"></div>', "<form action=/errors/validateCaptcha>", "<p>Algo deu errado</p>", "<a href=/ap/signin>x</a>", ""]
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", F.concat("html", F.get(literal_list(marks), (F.col("page_id") % 7).cast("int"))).alias("html")
    )


@query(
    "page_class",
    """SELECT label, challenge, count(*) AS pages FROM (SELECT CASE page_id % 7 WHEN 1 THEN 'hard_block' WHEN 2 THEN 'challenge' WHEN 3 THEN 'challenge'
        WHEN 4 THEN 'soft_error' WHEN 5 THEN 'auth_wall' ELSE 'valid' END AS label,
      CASE page_id % 7 WHEN 1 THEN 'hard_block' WHEN 2 THEN 'akamai_sec_cpt' WHEN 3 THEN 'amazon_image_captcha' WHEN 5 THEN 'auth_wall' END AS challenge FROM pages) GROUP BY ALL""",
)
def page_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.label_pages(marked_pages(spark, sf_dir)).groupBy("label", "challenge").agg(F.count("*").alias("pages"))


@query(
    "page_hosts",
    """SELECT lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, CASE page_id % 7 WHEN 1 THEN 'hard_block' WHEN 2 THEN 'challenge' WHEN 3 THEN 'challenge'
        WHEN 4 THEN 'soft_error' WHEN 5 THEN 'auth_wall' ELSE 'valid' END AS label, count(*) AS pages FROM pages GROUP BY 1, 2""",
)
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.label_report(pages.label_pages(marked_pages(spark, sf_dir)))


@query(
    "structured_offers",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN p_name ELSE p_name || ' LD' END AS title, CASE WHEN p_partkey % 4 = 2 THEN NULL ELSE CAST(p_retailprice AS DECIMAL(18,4)) END AS price,
      'SKU-' || CAST(p_partkey AS VARCHAR) AS product_id, p_partkey % 5 <> 0 OR p_partkey % 4 = 3 AS available FROM part""",
)
def structured_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product pages written from ``part``: JSON-LD alone, in a list, without a price, and item properties only."""
    key, price = F.col("p_partkey"), F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    offer = F.struct(
        F.when(key % 4 != 2, price).alias("price"), F.when(key % 5 == 0, "OutOfStock").otherwise("InStock").alias("availability")
    )
    ld = F.to_json(F.struct(F.lit("Product").alias("@type"), F.concat("p_name", F.lit(" LD")).alias("name"), F.concat(F.lit("SKU-"), key.cast("string")).alias("sku"), offer.alias("offers")))
    block = F.when(key % 4 == 1, F.concat(F.lit('[{"@type":"Brand","name":"x"},'), ld, F.lit("]"))).otherwise(ld)
    script = F.concat(F.lit('<script type="application/ld+json">'), block, F.lit("</script>"))
    props = F.concat(
        F.lit('<meta itemprop="price" content="'), price, F.lit('"><span itemprop="sku" content="SKU-'), key.cast("string"), F.lit('"></span>')
    )
    html = F.concat(F.lit("<html><head><title>shop</title></head><body><h1>"), "p_name", F.lit("</h1>"), F.when(key % 4 == 3, props).otherwise(script), F.lit("</body></html>"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("https://s.example/p/"), key.cast("string")).alias("url"), html.alias("html"))
    return pages.structured_offers(rows, "USD").select("p_partkey", "title", "price", "product_id", "available")


@query(
    "page_titles",
    """SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages""",
)
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", pages.page_title(F.col("html")).alias("title"))


@query(
    "page_kinds",
    """SELECT page_id % 3 AS store, page_id % 3 < 2 AS is_product, page_id % 3 = 2 AS is_results, page_id % 3 = 0 AS has_price, count(*) AS pages FROM pages GROUP BY ALL""",
)
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` moved to three shops, with that shop's marks for a product or a results page."""
    key = F.col("page_id")
    base = F.get(literal_list(["https://www.kabum.com.br/produto/", "https://www.amazon.com/dp/B0ABCDEFGH?x=", "https://www.kabum.com.br/busca/"]), (key % 3).cast("int"))
    mark = F.get(
        literal_list(['<script>{"@type":"Product","price": "10"}</script>', '<span id="productTitle">t</span>', '<a href="/produto/1">x</a>']), (key % 3).cast("int")
    )
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(base, key.cast("string")).alias("url"), F.concat("html", mark).alias("html"))
    flags = pages.page_kinds(pages.label_pages(rows))
    return flags.groupBy((key % 3).alias("store"), "is_product", "is_results", "has_price").agg(F.count("*").alias("pages"))


@query(
    "timed_promotions",
    """SELECT event_id, epoch_us(CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts)::TIMESTAMP + INTERVAL 3 HOUR ELSE date_trunc('second', ts)::TIMESTAMP END) AS expires_us,
      (['campaign_countdown', 'lightning_deal', 'flash_sale'])[CAST(event_id % 3 AS INTEGER) + 1] AS promotion_type FROM events""",
)
def timed_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, at = F.col("event_id"), F.col("at")
    rows = table(spark, sf_dir, "events").select("event_id", utc("ts").alias("at"))
    html = (
        F.when(key % 3 == 0, F.concat(F.lit("<script>$('#ctd9').countdown('2020/01/01 00:00:00');$('#ctd7').countdown('"), F.date_format(at, "yyyy/MM/dd HH:mm:ss"), F.lit("');</script>")))
        .when(key % 3 == 1, F.concat(F.lit('{"lightning_deal_configuration":{"finish_date":"'), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"}}')))
        .otherwise(F.concat(F.lit('{"end_time":'), F.unix_seconds(at).cast("string"), F.lit("}")))
    )
    store = F.get(literal_list(["terabyteshop", "mercadolivre", "shopee"]), (key % 3).cast("int"))
    found = pages.timed_promotions(rows.select("event_id", store.alias("store"), F.lit("7").alias("product_id"), html.alias("html")))
    return found.select("event_id", F.unix_micros("expires_at").alias("expires_us"), "promotion_type")


@query(
    "payment_conditions",
    """SELECT p_partkey, CAST(p_partkey % 20 + 1 AS DECIMAL(6,2)) AS cash_discount_percent, CASE WHEN p_partkey % 2 = 0 THEN 'pix' ELSE 'credit_card' END AS cash_discount_method,
      CAST(p_retailprice AS DECIMAL(18,4)) AS installment_total, p_partkey % 3 = 0 AS interest_free, p_partkey % 5 = 0 AS coupon_required FROM part""",
)
def payment_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    money = F.translate(F.format_number(F.col("p_retailprice").cast("decimal(18,2)"), 2), ",.", ".,")
    text = F.concat(
        F.lit("<p>"), (key % 20 + 1).cast("string"), F.lit("% off à vista no "), F.when(key % 2 == 0, "Pix").otherwise("cartão de crédito"),
        F.lit("</p><p>(total parcelado R$ "), money, F.lit(")</p>"), F.when(key % 3 == 0, "<p>10x de R$ 10,00 sem juros</p>").otherwise(""),
        F.when(key % 5 == 0, "<p>use o cupom</p>").otherwise(""),
    )
    found = pages.payment_conditions(table(spark, sf_dir, "part").select("p_partkey", text.alias("html")))
    return found.select("p_partkey", "cash_discount_percent", "cash_discount_method", "installment_total", "interest_free", "coupon_required")


@query(
    "image_links",
    """SELECT p_partkey, 'https://s.example/p/a.jpg|https://s.example/img/large/' || CAST(p_size AS VARCHAR) || '.jpg|https://cdn.example/x.jpg' AS links FROM part""",
)
def image_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    raw = F.array(
        F.lit("a.jpg"), F.concat(F.lit("/img/large/"), size, F.lit(".jpg")), F.lit("//cdn.example/x.jpg"),
        F.concat(F.lit("https://s.example/img/small/"), size, F.lit(".jpg")), F.lit(" "), F.lit("a.jpg"),
    )
    return spread(table(spark, sf_dir, "part")).select("p_partkey", F.array_join(pages.gallery(raw, F.lit("https://s.example/p/1")), "|").alias("links"))


# --- rate pages -------------------------------------------------------------------------------


@query(
    "rate_pages",
    """SELECT seq, rate_type, rate FROM (SELECT o_orderkey AS seq, unnest(CASE o_orderkey % 4 WHEN 0 THEN ['ptax_buy', 'ptax_sell'] WHEN 1 THEN ['official'] WHEN 2 THEN ['official', 'official']
        ELSE ['tourism_buy', 'tourism_sell'] END) AS rate_type, unnest(CASE o_orderkey % 4 WHEN 0 THEN [CAST(5.1155 AS DECIMAL(24,12)), CAST(r AS DECIMAL(24,12))] WHEN 1 THEN [CAST(r AS DECIMAL(24,12))]
        WHEN 2 THEN [CAST(r AS DECIMAL(24,12)), CAST(0.0008 AS DECIMAL(24,12))] ELSE [CAST(r AS DECIMAL(24,12)), CAST(5.5 AS DECIMAL(24,12))] END) AS rate
      FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS r FROM orders))""",
)
def rate_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived answers of the four rate sources, written from the order totals."""
    key, r = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(12,2)")
    plain = r.cast("string")
    latin = F.translate(F.format_number(r, 2), ",.", ".,")
    body = (
        F.when(key % 4 == 0, F.concat(F.lit('{"value":[{"cotacaoCompra":5.1155,"cotacaoVenda":'), plain, F.lit(',"dataHoraCotacao":"2026-09-22 13:03:30.646"},{"cotacaoCompra":1,"cotacaoVenda":2,"dataHoraCotacao":"x"}]}')))
        .when(key % 4 == 1, F.concat(F.lit("<table><tr><th>Data</th></tr><tr><td>22/09/2026</td><td>1</td><td>2</td><td>3</td><td><b>"), latin, F.lit("</b></td></tr><tr><td>21/09/2026</td><td>1</td><td>2</td><td>3</td><td>9,9</td></tr></table>")))
        .when(key % 4 == 2, F.concat(F.lit('<table class="t" id="cotizacion-interbancaria"><tr><td>Dolar</td><td>USD</td><td>1</td><td>'), latin, F.lit("</td></tr><tr><td>Real</td><td>BRL</td><td>0,1</td><td>1.250,00</td></tr></table>")))
        .otherwise(F.concat(F.lit("<table><tr><td>Dólar Turismo</td><td>"), latin, F.lit("</td><td>5,5</td><td>x</td><td>22/09/2026 13:03</td></tr></table>")))
    )
    source = F.get(literal_list(["bcb_ptax", "bcb_sml", "bcp_referential", "valor_data"]), (key % 4).cast("int"))
    archive = table(spark, sf_dir, "orders").select(key.alias("seq"), source.alias("source"), utc("o_orderdate").alias("fetched_at"), body.alias("body"))
    return rate_pages.rates(archive).select("seq", "rate_type", "rate")


