"""Queries over edges: validation, snapshots, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicker.operators import lookup as L
from wicker.operators import snapshot as S
from wicker.operators import validate as C
from wicker.plans import views as V
from wicker.plans.oracle_views import edge_ctes
from wicker.plans.registry import cte, query
from wicker.session import scratch_root, stage_table
from wicker.sources import store

edge_ctes(V.WINDOW, V.MODEL)
ENDS = [*C.SOURCE, *C.TARGET, "relationship_type"]
ENDS_SQL = ", ".join(ENDS)


def validated(spark, sf):
    return C.validate(V.dirty_edges(spark, sf))


@query(
    "validate_accepted",
    f"""SELECT seq, {ENDS_SQL}, evidence_kind, model_version FROM validated WHERE reject_code IS NULL""",
    "validated",
)
def _(spark, sf):
    return C.accepted(validated(spark, sf)).select("seq", *ENDS, "evidence_kind", "model_version")


@query(
    "validate_rejected",
    f"SELECT seq, {ENDS_SQL}, reject_code FROM validated WHERE reject_code IS NOT NULL",
    "validated",
)
def _(spark, sf):
    return C.rejected(validated(spark, sf)).select("seq", *ENDS, "reject_code")


@query(
    "validation_stats",
    """SELECT count(*) AS relationships_read, count(*) FILTER (reject_code IS NULL) AS relationships_accepted,
       count(*) FILTER (reject_code IS NOT NULL) AS relationships_rejected,
       (SELECT string_agg(reject_code || '=' || n, ',' ORDER BY reject_code) FROM
         (SELECT reject_code, count(*) AS n FROM validated WHERE reject_code IS NOT NULL GROUP BY 1)) AS rejected_by_code,
       count(DISTINCT source_product_id) FILTER (reject_code IS NULL) AS distinct_source_products_accepted,
       count(DISTINCT target_product_id) FILTER (reject_code IS NULL) AS distinct_target_products_accepted
       FROM validated""",
    "validated",
)
def _(spark, sf):
    entries = F.transform(
        F.map_entries("rejected_by_code"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    )
    return C.stats(validated(spark, sf)).withColumn("rejected_by_code", F.array_join(entries, ","))


@query(
    "validation_warnings",
    """SELECT CASE WHEN n = 0 THEN 'EMPTY_INPUT' WHEN accepted = 0 THEN 'NO_VALID_RELATIONSHIPS'
         ELSE 'PARTIAL_VALIDATION_SUCCESS' END AS code, accepted, n - accepted AS rejected
       FROM (SELECT count(*) AS n, count(*) FILTER (reject_code IS NULL) AS accepted FROM validated)
       WHERE n = 0 OR accepted = 0 OR n > accepted""",
    "validated",
)
def _(spark, sf):
    return C.warnings(validated(spark, sf))


@query(
    "stats_rollup",
    """SELECT relationship_type, model_version, month, grouping(relationship_type, model_version, month) AS level, count(*) AS read,
         count(*) FILTER (reject_code IS NULL) AS accepted, count(*) FILTER (reject_code IS NOT NULL) AS rejected,
         round(min(reliability) FILTER (reject_code IS NULL), 9) AS least_reliability, round(max(reliability) FILTER (reject_code IS NULL), 9) AS most_reliability
       FROM (SELECT *, strftime(window_from, '%Y-%m') AS month FROM validated) GROUP BY ROLLUP (relationship_type, model_version, month)""",
    "validated",
)
def _(spark, sf):
    """Validation counters with all subtotals."""
    found = C.rollup_stats(validated(spark, sf))
    return found.withColumns({c: F.round(c, 9) for c in ("least_reliability", "most_reliability")})


@query("snapshot_canonical", f"SELECT {ENDS_SQL}, round(reliability, 9) AS reliability FROM valid_edges", "valid_edges")
def _(spark, sf):
    return S.canonical_order(V.valid_edges(spark, sf).select(*C.EDGE)).select(*ENDS, F.round("reliability", 9).alias("reliability"))


def field(name: str) -> str:
    if name in ("support", "confidence", "lift", "transition_probability", "median_lag_days", "reliability"):
        text = f"printf('%.11e', {name})"
    elif name in ("window_from", "window_to"):
        text = f"strftime({name}, '%Y-%m-%d %H:%M:%S.%g')"
    else:
        text = f"CAST({name} AS VARCHAR)"
    return sized_sql(text)


def sized_sql(text: str) -> str:
    return f"coalesce(length({text}) || ':' || {text}, '-')"


def digest_ctes(name: str, edges: str) -> None:
    """The digest of an edge table, as a table of that name."""
    cte(f"{name}_prints", f"SELECT sha256({' || '.join(field(c) for c in C.EDGE)}) AS h FROM {edges}", edges)
    lanes = " || '|' || ".join(
        f"CAST((SELECT sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT) FROM {name}_prints) AS VARCHAR)" for i in range(4)
    )
    cte(
        name,
        f"""
        SELECT 'sha256:' || sha256('1|' || {sized_sql("model_version")} || '|' || wf || '|' || wt || '|' || n || '|' || {lanes})
            AS snapshot_id, '1' AS schema_version, model_version, wf AS window_from, wt AS window_to, n AS relationship_count
        FROM (SELECT count(*) AS n, min(model_version) AS model_version,
                strftime(min(window_from), '%Y-%m-%d %H:%M:%S.%g') AS wf,
                strftime(max(window_to), '%Y-%m-%d %H:%M:%S.%g') AS wt FROM {edges})
        """,
        f"{name}_prints",
    )


digest_ctes("digest", "knowledge")
digest_ctes("valid_digest", "valid_edges")


@query("snapshot_digest", "SELECT * FROM digest", "digest")
def _(spark, sf):
    return S.digest(V.knowledge(spark, sf))


@query(
    "publish_checks",
    """
    SELECT 'MODEL_VERSION_MISMATCH' AS "check", count(*) FILTER (model_version <> 'same-order-v1') AS violations
      FROM dirty_edges
    UNION ALL SELECT 'MIXED_MODEL_VERSIONS', count(DISTINCT model_version) - 1 FROM dirty_edges
    UNION ALL SELECT 'MIXED_EVIDENCE_WINDOWS', count(DISTINCT window_from) - 1 FROM dirty_edges
    UNION ALL SELECT 'DUPLICATE_VALIDATED_RELATIONSHIP', CAST(sum(n - 1) AS BIGINT) FROM
      (SELECT count(*) AS n FROM dirty_edges GROUP BY source_product_id, source_combination_id, target_product_id,
         target_combination_id, relationship_type, model_version, window_from, window_to)
    """,
    "dirty_edges",
)
def _(spark, sf):
    return S.publish_checks(V.dirty_edges(spark, sf), F.lit(V.MODEL))


@query(
    "snapshot_stats",
    """SELECT count(*) AS relationships_read, count(*) AS relationships_published,
       count(DISTINCT source_product_id) AS distinct_source_products,
       count(DISTINCT target_product_id) AS distinct_target_products,
       count(DISTINCT source_product_id || '>' || target_product_id) AS distinct_directed_pairs FROM knowledge""",
    "knowledge",
)
def _(spark, sf):
    return S.snapshot_stats(V.knowledge(spark, sf))


_published: dict[tuple[str, str], str] = {}


def published(spark, sf: str) -> str:
    """Root of the knowledge base of these tables, published once a session; lookups read it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _published:
        root = own_root(spark, "knowledge")
        store.publish(V.knowledge(spark, sf), root, model_version=V.MODEL)
        _published[key] = root
    return _published[key]


def own_root(spark, name: str) -> str:
    """A snapshot root of its own for every run of a store query."""
    import uuid

    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "snapshot_write",
    "SELECT snapshot_id, unnest(['created', 'already_exists']) AS status FROM digest",
    "digest",
)
def _(spark, sf):
    """Write twice: created, then already_exists under the same id."""
    root = own_root(spark, "write")
    edges = stage_table(V.knowledge(spark, sf), "knowledge")
    results = [store.write_snapshot(edges, root), store.write_snapshot(edges, root)]
    return spark.createDataFrame([(i, s) for i, s in results], "snapshot_id string, status string")


@query(
    "snapshot_activate",
    """SELECT 0 AS step, snapshot_id AS active_snapshot_id FROM valid_digest
       UNION ALL SELECT 1, snapshot_id FROM digest UNION ALL SELECT 2, snapshot_id FROM valid_digest""",
    "valid_digest",
    "digest",
)
def _(spark, sf):
    """Activate one snapshot, then another, then roll back."""
    root = own_root(spark, "activate")
    valid = stage_table(V.valid_edges(spark, sf), "edges")
    first, _ = store.write_snapshot(valid, root)
    second, _ = store.write_snapshot(V.knowledge(spark, sf, valid), root)
    seen = []
    for step, target in enumerate([first, second, first]):
        store.activate(spark, root, target)
        seen.append((step, store.active_id(spark, root)))
    return spark.createDataFrame(seen, "step int, active_snapshot_id string")


@query("snapshot_read", f"SELECT {ENDS_SQL}, round(reliability, 9) AS reliability FROM knowledge", "knowledge")
def _(spark, sf):
    """Publish, then read the active snapshot."""
    root = own_root(spark, "read")
    store.publish(V.knowledge(spark, sf), root)
    return store.read_snapshot(spark, root).select(*ENDS, F.round("reliability", 9).alias("reliability"))


@query(
    "publish",
    """SELECT snapshot_id, 'created' AS status, relationship_count AS relationships_published,
       snapshot_id AS active_snapshot_id FROM digest""",
    "digest",
)
def _(spark, sf):
    root = own_root(spark, "publish")
    done = store.publish(V.knowledge(spark, sf), root, model_version=V.MODEL)
    row = (done["snapshot_id"], done["status"], done["relationships_published"], store.active_id(spark, root))
    return spark.createDataFrame(
        [row], "snapshot_id string, status string, relationships_published bigint, active_snapshot_id string"
    )


@query(
    "index_checks",
    """
    SELECT 'RELATIONSHIP_COUNT' AS "check", abs((SELECT count(*) FROM dirty_edges) - (SELECT count(*) FROM edges)) AS violations
    UNION ALL SELECT 'MODEL_VERSION', count(*) FILTER (model_version <> 'same-order-v1') FROM dirty_edges
    UNION ALL SELECT 'EVIDENCE_WINDOW', count(*) FILTER (window_from <> TIMESTAMP '1995-01-01') FROM dirty_edges
    UNION ALL SELECT 'PRODUCT_REFERENCE', count(*) FILTER (trim(source_product_id) = '' OR trim(target_product_id) = '')
      FROM dirty_edges
    UNION ALL SELECT 'DUPLICATE_RELATIONSHIP', CAST(sum(n - 1) AS BIGINT) FROM
      (SELECT count(*) AS n FROM dirty_edges GROUP BY source_product_id, source_combination_id, target_product_id,
         target_combination_id, relationship_type, model_version, window_from, window_to)
    """,
    "dirty_edges",
)
def _(spark, sf):
    """Spoilt edges against the metadata of the good ones."""
    edges = stage_table(V.edges(spark, sf), "edges")
    return L.index_checks(V.dirty_edges(spark, sf, edges), S.digest(edges))


CANONICAL = """source_product_id, source_combination_id NULLS FIRST, target_product_id,
  target_combination_id NULLS FIRST, relationship_type, model_version, window_from, window_to"""
cte(
    "found",
    f"""
    SELECT r.request_id, r.lim, k.*, row_number() OVER (PARTITION BY request_id ORDER BY {CANONICAL.replace("source_product_id", "k.source_product_id", 1)}) AS position,
      count(target_product_id) OVER (PARTITION BY request_id) AS total_matched
    FROM source_requests r LEFT JOIN knowledge k ON k.source_product_id = r.source_product_id
      AND (r.relationship_types IS NULL OR list_contains(r.relationship_types, k.relationship_type))
    """,
    "source_requests",
    "knowledge",
)


@query(
    "find_by_source",
    """SELECT request_id, target_product_id, target_combination_id, relationship_type,
       CASE WHEN target_product_id IS NOT NULL THEN CAST(position AS INTEGER) END AS position, total_matched,
       least(total_matched, coalesce(lim, total_matched)) AS returned FROM found
       WHERE position <= least(total_matched, coalesce(lim, total_matched)) OR total_matched = 0""",
    "found",
)
def _(spark, sf):
    requests = V.source_requests(spark, sf)
    found = L.find_by_source(requests, store.read_for(spark, published(spark, sf), requests))
    return found.select("request_id", *C.TARGET, "relationship_type", "position", "total_matched", "returned")


@query(
    "find_related",
    f"""SELECT {ENDS_SQL}, round(reliability, 9) AS reliability, CAST(rank AS INTEGER) AS rank FROM
        (SELECT *, row_number() OVER (PARTITION BY source_product_id ORDER BY reliability DESC,
           confidence DESC NULLS LAST, lift DESC NULLS LAST, joint_count DESC NULLS LAST, target_product_id,
           target_combination_id NULLS FIRST, relationship_type) AS rank FROM knowledge) WHERE rank <= 2""",
    "knowledge",
)
def _(spark, sf):
    requests = V.source_requests(spark, sf)
    found = L.find_related(requests, store.read_for(spark, published(spark, sf), requests), ["same_order", "manual"], 2)
    return found.select(*ENDS, F.round("reliability", 9).alias("reliability"), "rank")


@query(
    "snapshot_metadata",
    "SELECT digest.*, (SELECT count(DISTINCT source_product_id) FROM knowledge) AS source_count FROM digest",
    "digest",
)
def _(spark, sf):
    root = published(spark, sf)
    return L.snapshot_metadata(store.read_snapshot(spark, root), store.metadata(spark, root, store.active_id(spark, root)))


@query(
    "snapshot_diff",
    f"""SELECT {ENDS_SQL}, 'appeared' AS change FROM (
          SELECT {", ".join(C.IDENTITY)} FROM knowledge EXCEPT SELECT {", ".join(C.IDENTITY)} FROM valid_edges)
        UNION ALL SELECT {ENDS_SQL}, 'vanished' FROM (
          SELECT {", ".join(C.IDENTITY)} FROM valid_edges EXCEPT SELECT {", ".join(C.IDENTITY)} FROM knowledge)""",
    "knowledge",
    "valid_edges",
)
def _(spark, sf):
    """What the knowledge base has that the mined edges lack, and the other way round."""
    root = own_root(spark, "diff")
    valid = stage_table(V.valid_edges(spark, sf), "edges")
    old, _ = store.write_snapshot(valid, root)
    new, _ = store.write_snapshot(V.knowledge(spark, sf, valid), root)
    return store.diff(spark, root, old, new).select(*ENDS, "change")
