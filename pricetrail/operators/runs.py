"""Match runs: liveness, backlog, roll-ups, notifications and store order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import blank_to_null
from ..rules import stores as rules
from .catalog import is_synthetic

# Statuses, limits and texts.
TERMINAL = (
    "match", "no_match", "error", "refresh_updated", "refresh_unchanged", "refresh_out_of_stock", "refresh_removed",
    "refresh_failed", "refresh_deferred",
)
ERRORS = ("error", "refresh_failed")
MAX_ATTEMPTS = 3
LEASE_SECONDS = 600
STALL_SECONDS = 600
WORKER_LOST = "worker_lost"
WORKER_LOST_MESSAGE = "A busca foi interrompida (worker perdido ou lease expirada). Inicie uma nova busca."
REFERENCE_STORE_RANK = {
    "kabum": 100, "amazon_br": 95, "amazon": 90, "magazineluiza": 85, "magalu": 85, "pichau": 80, "terabyte": 80,
    "terabyteshop": 80, "nissei": 75, "bestbuy": 55, "shoppingchina": 25, "mercadolivre": 15, "shopee": 15,
}
OTHER_STORE_RANK = 40


def lease_valid(now: Column) -> Column:
    return F.coalesce(F.col("claim_expires_at") > now, F.lit(False))


def liveness(now: Column) -> Column:
    """active (waiting, or running under a lease), stale (running without one), or the final status."""
    status = F.lower("status")
    return (
        F.when(status == "pending", "active")
        .when((status == "running") & lease_valid(now), "active")
        .when(status == "running", "stale")
        .otherwise(status)
    )


def claimable(now: Column) -> Column:
    return F.col("status").isin("pending", "running") & ~lease_valid(now)


def backlog(runs: DataFrame, now: Column, limit: int) -> DataFrame:
    """Runs that wait for a worker, oldest first."""
    return runs.where(claimable(now)).orderBy("started_at", "id").limit(max(1, limit))


def stale_runs(runs: DataFrame, now: Column, limit: int) -> DataFrame:
    return runs.where(liveness(now) == "stale").orderBy("started_at", "id").limit(max(1, limit))


def active_runs(runs: DataFrame, now: Column) -> DataFrame:
    """The newest active run per product."""
    live = runs.where(liveness(now) == "active")
    rest = [c for c in runs.columns if c != "product_id"]
    return live.groupBy("product_id").agg(F.max_by(F.struct(*rest), F.struct("started_at", "id")).alias("r")).select("product_id", "r.*")


def start_runs(requests: DataFrame, runs: DataFrame, stores: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """New runs for products without an active one, and one pending row per target store.

    ``requests``: product_id, requested_by, reference_url, reference_store,
    reference_country, seq. ``stores`` is the fixed store dimension.
    """
    one = requests.groupBy("product_id").agg(F.min_by(F.struct("requested_by", "reference_url", "reference_store", "reference_country"), "seq").alias("r"))
    idle = one.join(active_runs(runs, now).select("product_id"), "product_id", "left_anti")
    made = idle.select(
        F.sha2(F.concat_ws("|", F.col("product_id").cast("string"), F.unix_micros(now).cast("string")), 256).alias("id"),
        "product_id", "r.*", F.lit("pending").alias("status"), now.alias("started_at"), F.lit(0).alias("attempts"),
    )
    # the store dimension as one array value: every new run is exploded over it
    targets = eligible_stores(stores).agg(F.array_sort(F.collect_list(F.struct("store_key", "store", "country", "label")))).scalar()
    rows = made.withColumn("__targets", targets)

    def is_other(t):
        same_name = (t["store"] == F.lower("reference_store")) & (
            F.col("reference_country").isNull() | (t["country"] == F.upper("reference_country"))
        )
        return ~F.coalesce((t["store_key"] == F.lower("reference_store")) | same_name, F.lit(False))

    seeds = rows.select(F.col("id").alias("run_id"), F.explode(F.filter("__targets", is_other)).alias("t")).select(
        "run_id", F.col("t.store_key").alias("store"), F.col("t.label").alias("display_name"), F.lit("pending").alias("status")
    )
    return made, seeds


def eligible_stores(stores: DataFrame) -> DataFrame:
    return stores.where(F.col("implemented") & F.col("match_enabled"))


def order_stores(stores: DataFrame, reference_store: str | None = None, reference_has_gtin: bool = False) -> DataFrame:
    """Stores (store_key) in search order with their wave: barcode-rich ones of the main locale first.

    The main locale is the home locale if any store has it, else the most common
    one. The table is the store dimension, a few dozen rows.
    """
    known = rules.store_table(stores.sparkSession).select("store_key", "barcode_rank", "locale_rank")
    keyed = stores.select(F.lower(F.trim("store_key")).alias("store_key")).where("store_key <> ''").distinct()
    rows = keyed.join(F.broadcast(known), "store_key", "left").withColumns(
        {
            "barcode_rank": F.coalesce("barcode_rank", F.lit(rules.DEFAULT_BARCODE_RANK)),
            "locale_rank": F.coalesce("locale_rank", F.lit(rules.DEFAULT_LOCALE_RANK)),
        }
    )
    home = F.lit(rules.HOME_LOCALE_RANK)
    main = rows.agg(
        F.when(F.bool_or(F.col("locale_rank") == home), home).otherwise(F.mode("locale_rank", deterministic=True)).alias("main_locale")
    )
    rich = F.col("barcode_rank") <= rules.FIRST_WAVE_MAX_RANK
    rows = rows.withColumn("wave", F.when(F.col("locale_rank") != main.scalar(), 3).when(rich, 1).otherwise(2))
    reference = (reference_store or "").strip().lower()
    last = (F.col("store_key") == reference) & F.lit(bool(reference) and not reference_has_gtin)
    return rows.withColumn("reference_last", last.cast("int")).orderBy(
        "reference_last", "locale_rank", "barcode_rank", "store_key"
    )


# --- roll-ups ---------------------------------------------------------------------------------


def run_rollup(store_runs: DataFrame) -> DataFrame:
    """Per run: finished stores, matches, no-matches and errors."""
    status = F.col("status")
    return store_runs.groupBy("run_id").agg(
        F.count("*").alias("stores_total"),
        F.count_if(status.isin(*TERMINAL)).alias("stores_completed"),
        F.count_if(status == "match").alias("matches"),
        F.count_if(status == "no_match").alias("no_matches"),
        F.count_if(status.isin(*ERRORS)).alias("errors"),
    )


def terminal_stores(store_runs: DataFrame) -> DataFrame:
    """Set of finished stores per run; one row per store first, so sets stay as small as the store list."""
    done = store_runs.where(F.col("status").isin(*TERMINAL)).select("run_id", "store").distinct()
    return done.groupBy("run_id").agg(F.array_sort(F.collect_list("store")).alias("stores"))


def open_stores(targets: DataFrame, store_runs: DataFrame) -> DataFrame:
    """Target (run_id, store) pairs that are not finished."""
    done = store_runs.where(F.col("status").isin(*TERMINAL)).select("run_id", "store")
    return targets.join(done, ["run_id", "store"], "left_anti")


def finish_runs(runs: DataFrame, store_runs: DataFrame, now: Column) -> DataFrame:
    """Runs completed at ``now`` with totals and active processing time (from the claim, never below 0).

    ``runs`` carries the reported totals: matches_found, stores_completed.
    """
    totals = run_rollup(store_runs).select("run_id", F.col("stores_completed").alias("__done"), "matches", "no_matches", "errors")
    since = F.coalesce("claimed_at", "started_at", now)
    return runs.join(totals, runs["id"] == totals["run_id"], "left").withColumns(
        {
            "status": F.lit("completed"),
            "finished_at": now,
            "total_duration_ms": F.greatest(F.lit(0).cast("long"), F.unix_millis(now) - F.unix_millis(since)),
            "stores_completed": F.greatest(F.coalesce("stores_completed", F.lit(0)), F.coalesce("__done", F.lit(0))),
        }
    ).drop("__done", "run_id")


def fail_exhausted(runs: DataFrame, now: Column, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Stale runs out of attempts, as failed."""
    gone = (liveness(now) == "stale") & (F.coalesce("attempts", F.lit(0)) >= max(1, max_attempts))
    since = F.coalesce("claimed_at", "started_at", now)
    return runs.where(gone).withColumns(
        {
            "total_duration_ms": F.greatest(F.lit(0).cast("long"), F.unix_millis(now) - F.unix_millis(since)),
            "status": F.lit("failed"),
            "failure_code": F.lit(WORKER_LOST),
            "failure_message": F.lit(WORKER_LOST_MESSAGE),
            "finished_at": now,
        }
    )


def notifications(finished: DataFrame, products: DataFrame) -> DataFrame:
    """One notification per finished run that a user asked for."""
    rows = finished.where(F.col("requested_by").isNotNull()).join(
        products.select(F.col("id").alias("product_id"), F.col("title").alias("product_title")), "product_id", "left"
    )
    ok = F.col("status") == "completed"
    lost = F.col("failure_code") == WORKER_LOST
    name = F.coalesce(blank_to_null(F.col("product_title")), F.lit("Produto"))
    took = dates.hms(F.col("total_duration_ms"))
    found = F.coalesce("matches_found", F.lit(0))
    total = F.coalesce("stores_total", F.lit(0))
    message = (
        F.when(ok & (found > 0), F.format_string("%s — %d oferta(s) encontrada(s) em %d loja(s). Tempo total: %s.", name, found, total, took))
        .when(ok, F.format_string("Busca concluída sem novas ofertas em %d loja(s). Tempo total: %s.", total, took))
        .when(lost, F.format_string("%s — a execução foi interrompida antes da conclusão (worker perdido). Tempo ativo: %s.", name, took))
        .otherwise(F.format_string("%s — a busca falhou. Tempo: %s. Consulte o log da execução.", name, took))
    )
    return rows.select(
        F.col("requested_by").alias("user_id"),
        F.when(ok, "PRODUCT_MATCH_COMPLETED").otherwise("PRODUCT_MATCH_FAILED").alias("type"),
        F.when(ok, "Busca concluída").when(lost, "Busca interrompida").otherwise("Busca em outras lojas não concluída").alias("title"),
        message.alias("message"), "product_id", F.col("id").alias("match_run_id"), F.col("finished_at").alias("created_at"),
    )


def new_notifications(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Notifications not yet stored: one per (match_run_id, type); an existing one stays as it is."""
    keys = ["match_run_id", "type"]
    rest = [c for c in batch.columns if c not in keys]
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("created_at", "user_id")).alias("r")).select(*keys, "r.*")
    return first.join(existing.select(*keys), keys, "left_anti").select(*batch.columns)


def unread(notes: DataFrame) -> DataFrame:
    return notes.groupBy("user_id").agg(F.count_if(F.col("read_at").isNull()).alias("unread"))


def newest_per(rows: DataFrame, key: str, at: str, id_column: str, limit: int, offset: int = 0) -> DataFrame:
    """Page of each key's newest rows. A hot key's rows are cut to the page before they meet.

    Rows are ranked inside fixed random slices first, so no task sorts a whole hot
    key; each slice passes on at most ``limit + offset`` rows.
    """
    last = limit + offset
    newest = [F.desc(at), F.desc(id_column)]
    slice_ = F.pmod(F.xxhash64(F.col(id_column)), F.lit(64))
    first = rows.withColumn("__slice", slice_).withColumn(
        "__n", F.row_number().over(Window.partitionBy(key, "__slice").orderBy(*newest))
    ).where(F.col("__n") <= last)
    ranked = first.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*newest)))
    return ranked.where((F.col("__n") > offset) & (F.col("__n") <= last)).drop("__slice", "__n")


def candidate_log(candidates: DataFrame) -> DataFrame:
    """Candidate evidence to append: all of each store run, numbered from one by ``seq``, which is unique there."""
    from ..sequences import KeyedSequence

    return KeyedSequence(candidates, ["run_id", "store"], ["seq"]).running({"sequence": F.lit(1)}).result()


def live_view(runs: DataFrame, store_runs: DataFrame, products: DataFrame, now: Column) -> DataFrame:
    """Progress rows of runs: run, product and each store's state with its matched offer."""
    titles = products.select(F.col("id").alias("product_id"), F.col("title").alias("product_title"))
    rows = runs.withColumn("liveness", liveness(now)).withColumnsRenamed({"id": "run_id", "status": "run_status"}).join(titles, "product_id")
    per_store = store_runs.select(
        "run_id", "store", F.col("status").alias("store_status"), "duration_ms",
        F.get_json_object("matched_payload", "$.title").alias("matched_title"),
        F.get_json_object("matched_payload", "$.price").try_cast("decimal(18,4)").alias("matched_price"),
        F.get_json_object("matched_payload", "$.currency").alias("matched_currency"),
    )
    return rows.join(per_store, "run_id", "left").withColumn(
        "is_active", F.col("liveness") == "active"
    )


def with_candidates(store_runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Store runs with their candidate log nested (``candidate_log``)."""
    logged = candidate_log(candidates)
    nested = logged.groupBy("run_id", "store").agg(
        F.array_sort(F.collect_list(F.struct("sequence", "title", "decision", "confidence"))).alias("candidates")
    )
    return store_runs.join(nested, ["run_id", "store"], "left")


def reference_links(listings: DataFrame) -> DataFrame:
    """The listing to start a product's search from: active ones first, then the store's rank, then a clean link."""
    real = listings.where(~is_synthetic(F.col("store"), F.col("url"), F.col("product_id")))
    link = F.coalesce(blank_to_null(F.col("canonical_url")), blank_to_null(F.col("url")))
    rank = F.coalesce(_lookup_rank(F.lower("store")), F.lit(OTHER_STORE_RANK)) + F.when(
        F.col("canonical_url").isNotNull(), 3
    ).when(F.col("url").isNotNull(), 2).otherwise(0)
    active = F.lower("status") == "active"
    best = F.max_by("link", F.struct("active", "rank", F.col("link")))
    return (
        real.withColumns({"link": link, "rank": rank, "active": active})
        .where(F.col("link").isNotNull())
        .groupBy(F.col("canonical_product_id").alias("product_id"))
        .agg(best.alias("reference_url"))
    )


def _lookup_rank(store: Column) -> Column:
    pairs = ", ".join(f"'{k}', {v}" for k, v in REFERENCE_STORE_RANK.items())
    return F.try_element_at(F.expr(f"map({pairs})"), store)


def stalled(progress: DataFrame, runs: DataFrame, now: Column, after: int = STALL_SECONDS) -> DataFrame:
    """Active runs without progress for too long."""
    last = progress.groupBy("run_id").agg(F.max("at").alias("last_progress_at"))
    live = runs.where(liveness(now) == "active").select(F.col("id").alias("run_id"), "started_at")
    rows = live.join(last, "run_id", "left").withColumn("last_progress_at", F.coalesce("last_progress_at", "started_at"))
    idle = F.unix_timestamp(now) - F.unix_timestamp("last_progress_at")
    return rows.withColumn("idle_seconds", idle).where(F.col("idle_seconds") >= after)
