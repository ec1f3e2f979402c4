"""Queries of model answers, scores, suggestions, feedback and records, with oracles that say the same in another way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage, evaluate, graph, imagery, vision
from ..sources import adapters as own
from ..sources import sinks
from ..streaming import feedback
from .dialect import duck_text
from .images import SEGMENT, rows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    def mark(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = duck_text(oracle)
        return f

    return mark


_DET = f"({own.DETECTIONS}) d"


@query(f"SELECT type, n, row_number() OVER (ORDER BY n DESC, first_id) AS pos FROM (SELECT type, count(*) AS n, min(id) AS first_id FROM {_DET} WHERE usable AND permanence IS DISTINCT FROM 'temporary' GROUP BY type) t")
def detections_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lasting detections by type, the commonest first."""
    kept = rows(spark, sf_dir, f"SELECT id AS ord, type FROM {_DET} WHERE usable AND coalesce(permanence, 'permanent') = 'permanent'")
    return coverage.by_first(kept, F.col("type"), "type")


@query(f"SELECT frame_id, string_agg(type, ',' ORDER BY type) AS types FROM (SELECT frame_id, type FROM {_DET} WHERE usable AND permanence IS DISTINCT FROM 'temporary' AND NOT confidence < 0.5 GROUP BY ALL) t GROUP BY frame_id")
def predicted_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each frame shows for sure."""
    return evaluate.predicted_types(rows(spark, sf_dir, f"SELECT * FROM {_DET}")).select("frame_id", F.array_join("types", ",").alias("types"))


_TYPES = ["stairs", "raised_curb", "narrow", "steep"]
_LABELS = "SELECT doc_id, quality = 1 AS usable, CASE WHEN doc_id % 3 = 0 THEN 'stairs' WHEN doc_id % 3 = 1 THEN 'raised_curb' END AS t1, CASE WHEN toxic = 1 THEN 'narrow' END AS t2 FROM {labels} l WHERE quality IS NOT NULL"
_SAID = "SELECT doc_id, n_chars >= 500 AS usable, CASE WHEN n_chars % 3 = 0 THEN 'stairs' WHEN n_chars % 3 = 1 THEN 'raised_curb' END AS t1, CASE WHEN n_chars % 11 = 0 THEN 'narrow' END AS t2 FROM {documents} d WHERE n_chars % 13 > 0"
_CASES = f"SELECT l.doc_id, t.type, coalesce(t.type IN (l.t1, l.t2), false) AS there, coalesce(t.type IN (s.t1, s.t2), false) AS said FROM ({_LABELS}) l JOIN ({_SAID}) s ON s.doc_id = l.doc_id CROSS JOIN (VALUES ('stairs'), ('raised_curb'), ('narrow'), ('steep')) AS t(type)"


def _scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    types = F.array_compact(F.array("t1", "t2"))
    labels = rows(spark, sf_dir, _LABELS).select(F.col("doc_id").alias("frame_id"), "usable", types.alias("present"))
    return evaluate.frame_scores(labels, rows(spark, sf_dir, _SAID).select(F.col("doc_id").alias("frame_id"), "usable", types.alias("types")), _TYPES)


_MEASURED = "SELECT type, tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 3) END AS precision_, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 3) END AS recall_, CASE WHEN tp + fp > 0 AND tp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 3) END AS f1 FROM"


@query(f"""{_MEASURED} (SELECT type, count_if(there AND said) AS tp, count_if(said AND NOT there) AS fp, count_if(there AND NOT said) AS fn, NULL AS tn FROM ({_CASES}) c GROUP BY type HAVING tp + fp + fn > 0
  UNION ALL SELECT 'micro', count_if(there AND said), count_if(said AND NOT there), count_if(there AND NOT said), NULL FROM ({_CASES}) c
  UNION ALL SELECT 'usable', count_if(l.usable AND s.usable), count_if(NOT l.usable AND s.usable), count_if(l.usable AND NOT s.usable), count_if(NOT l.usable AND NOT s.usable) FROM ({_LABELS}) l JOIN ({_SAID}) s ON s.doc_id = l.doc_id) m""")
def frame_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of reported types against labels, and of usability."""
    return _scores(spark, sf_dir)[0]


@query(f"SELECT doc_id AS frame_id, type, CASE WHEN said THEN 'fp' ELSE 'fn' END AS kind FROM ({_CASES}) c WHERE there <> said")
def frame_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where answers and labels differ."""
    return _scores(spark, sf_dir)[1]


@query(f"SELECT frame_id, n // 8 + 1 AS sheet, n % 8 // 4 AS row, n % 4 AS \"column\", 'label: ' || present || ' | ' || what AS caption FROM (SELECT *, row_number() OVER (ORDER BY frame_id) - 1 AS n FROM (SELECT CAST(c.doc_id AS VARCHAR) AS frame_id, coalesce(nullif(concat_ws(', ', any_value(l.t1), any_value(l.t2)), ''), 'none') AS present, string_agg(CASE WHEN said THEN 'FP:' ELSE 'FN:' END || type, ' ' ORDER BY CASE WHEN said THEN 'FP:' ELSE 'FN:' END || type) AS what FROM ({_CASES}) c JOIN ({_LABELS}) l ON l.doc_id = c.doc_id WHERE there <> said GROUP BY c.doc_id) g) s")
def error_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact sheets of frames with errors, as rows."""
    errors = _scores(spark, sf_dir)[1].withColumn("frame_id", F.col("frame_id").cast("string"))
    labels = rows(spark, sf_dir, _LABELS).select(F.col("doc_id").cast("string").alias("frame_id"), F.array_compact(F.array("t1", "t2")).alias("present"))
    none = F.array().cast("array<struct<type:string,box_2d:array<int>,confidence:double>>")
    made = evaluate.error_sheet(errors, labels, labels.select("frame_id", none.alias("features")))
    return made.select("frame_id", "sheet", "row", "column", F.expr("substring(caption, instr(caption, '|') + 2)").alias("caption"))


@query("SELECT event_id AS id, (('0x' || right(sha1(CAST(event_id AS VARCHAR)), 1))::INT + 6 * list_sum(list_transform(string_split(left(sha1(CAST(event_id AS VARCHAR)), 39), ''), lambda c: ('0x' || c)::INT))) % 10 IN (0, 1, 2) AS holdout FROM {events}")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold-out flag of every id, row by row."""
    return rows(spark, sf_dir, "SELECT event_id AS id FROM {events}").select("id", evaluate.is_holdout(F.col("id")).alias("holdout"))


_OBJECTS = "SELECT s_suppkey AS i, CASE WHEN s_suppkey % 2 = 0 THEN 'stairs' ELSE 'raised_curb' END AS type, s_suppkey * 37 % 50 * 40.0 AS x1, s_suppkey * 53 % 20 * 40.0 AS y1, s_suppkey * 37 % 50 * 40.0 + CASE WHEN s_suppkey % 2 = 0 THEN 15 ELSE 0 END AS x2, s_suppkey * 53 % 20 * 40.0 AS y2 FROM {supplier}"
_FOUND = f"SELECT id AS j, CASE WHEN id % 2 = 0 THEN 'stairs' ELSE 'raised_curb' END AS type, mx AS x, my AS y FROM {_DET}"
_SAME_POINT = "CASE WHEN o.x1 = o.x2 THEN sqrt(pow(f.x - o.x1, 2) + pow(f.y - o.y1, 2)) ELSE " + SEGMENT.format(px="f.x", py="f.y", ax="o.x1", ay="o.y1", bx="o.x2", by="o.y2") + " END"


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from .images import lined

    truth, found = lined(rows(spark, sf_dir, _OBJECTS)), rows(spark, sf_dir, _FOUND)
    return evaluate.truth_pairs(truth, found), truth.withColumn("holdout", evaluate.is_holdout(F.col("i"))), found


@query(f"SELECT * FROM (SELECT o.type, o.i, f.j, round({_SAME_POINT}, 3) AS d FROM ({_OBJECTS}) o JOIN ({_FOUND}) f ON f.type = o.type AND f.x BETWEEN o.x1 - 10 AND o.x2 + 10 AND f.y BETWEEN o.y1 - 10 AND o.y2 + 10 WHERE {_SAME_POINT} <= 10) q")
def truth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped objects and detections of the same type within ten metres."""
    return _pairs(spark, sf_dir)[0].withColumn("d", F.round("d", 3))


@query(None)
def matched_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy one-to-one matching of these pairs."""
    met = _pairs(spark, sf_dir)[0]
    taken = graph.greedy_match(met.select(F.struct("type", "i").alias("i"), F.struct("type", "j").alias("j"), F.round("d", 6).alias("d")))
    return taken.select("i.type", "i.i", "j.j", F.round("d", 3).alias("d"))


@query(None)
def map_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores against mapped objects, of those held out."""
    met, truth, found = _pairs(spark, sf_dir)
    return evaluate.truth_metrics(met.withColumn("d", F.round("d", 6)), truth.select("type", "i", "holdout"), found.select("type", "j"), True)


_CURBS = f"SELECT id, type, permanence, confidence, id % 4 AS n_views, lon, lat, frame_id AS best_frame, captured_at AS last_seen, height_cm, 'seen' AS description FROM {_DET}"
_MAPPED = f"SELECT s_suppkey AS shape, CASE WHEN s_suppkey % 2 = 0 THEN 'kerb' ELSE 'steps' END AS kind, {own.LON} + s_suppkey * 37 % 50 * 40 * {own.EAST!r} AS lon1, {own.LAT} + s_suppkey * 53 % 20 * 40 * {own.NORTH!r} AS lat1, {own.LON} + (s_suppkey * 37 % 50 * 40 + 30) * {own.EAST!r} AS lon2 FROM {{supplier}}"
#: The nearest point in degrees on a line to the east, and its metres by the semi-axes.
_FOOT = "CASE WHEN m.kind = 'kerb' OR c.lon < m.lon1 THEN m.lon1 WHEN c.lon > m.lon2 THEN m.lon2 ELSE c.lon END"


def _near(limit: str) -> str:
    from .images import _M, _N

    mid = "(c.lat + m.lat1) / 2"
    return f"sqrt(pow({_M.format(mid)} * radians(m.lat1 - c.lat), 2) + pow({_N.format(mid)} * cos(radians({mid})) * radians({_FOOT} - c.lon), 2)) <= {limit}"


_REASON = f"""CASE WHEN type NOT IN ('stairs', 'raised_curb', 'curb_ramp') THEN 'no_tag' WHEN permanence <> 'permanent' THEN 'temporary' WHEN confidence < 0.8 THEN 'low_confidence' WHEN n_views < 2 THEN 'few_views'
  WHEN (type = 'stairs' AND EXISTS (SELECT 1 FROM ({_MAPPED}) m WHERE m.kind = 'steps' AND {_near("20")})) OR (type <> 'stairs' AND EXISTS (SELECT 1 FROM ({_MAPPED}) m WHERE m.kind = 'kerb' AND {_near("10")})) THEN 'already_in_osm' END"""


def _suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda a, b: F.struct(F.col(a).alias("lon"), F.col(b).alias("lat"))
    mapped = rows(spark, sf_dir, _MAPPED)
    shapes = mapped.select("kind", "shape", F.when(F.col("kind") == "kerb", F.array(at("lon1", "lat1"))).otherwise(F.array(at("lon1", "lat1"), at("lon2", "lat1"))).alias("coords"))
    return evaluate.suggestions(rows(spark, sf_dir, _CURBS), shapes)


@query(f"SELECT id, CASE type WHEN 'stairs' THEN 'highway=steps' WHEN 'raised_curb' THEN 'kerb=raised' WHEN 'curb_ramp' THEN 'kerb=lowered' END AS tag, {_REASON} AS reason FROM ({_CURBS}) c")
def map_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barriers to suggest to the map, or the first reason against it."""
    return _suggested(spark, sf_dir).select("id", "tag", "reason")


@query(f"SELECT r.reason, count(q.id) AS n FROM (VALUES ('no_tag'), ('temporary'), ('low_confidence'), ('few_views'), ('already_in_osm'), ('suggested')) AS r(reason) LEFT JOIN (SELECT id, coalesce({_REASON}, 'suggested') AS reason FROM ({_CURBS}) c) q ON q.reason = r.reason GROUP BY r.reason")
def suggestion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many barriers each reason keeps back."""
    return evaluate.suggestion_counts(_suggested(spark, sf_dir))


@query(f"SELECT id, type AS barrier_type, CASE type WHEN 'stairs' THEN 'highway=steps' WHEN 'raised_curb' THEN 'kerb=raised' ELSE 'kerb=lowered' END AS suggested_tags, 'photos/' || string_split(best_frame, '_')[1] || '.jpg' AS photo, strftime(last_seen, '%Y-%m-%d') AS last_seen, CASE type WHEN 'stairs' THEN 'Add highway=steps.' WHEN 'raised_curb' THEN 'Add kerb=raised at the crossing.' ELSE 'Add kerb=lowered at the crossing.' END || ' Automatic detection: check the photo first.' AS instruction FROM (SELECT *, {_REASON} AS reason FROM ({_CURBS}) c) q WHERE reason IS NULL")
def suggestion_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mapper gets of each suggestion."""
    return evaluate.suggestion_features(_suggested(spark, sf_dir), "photos/{image}.jpg").select("id", "barrier_type", "suggested_tags", "photo", "last_seen", "instruction")


# answers and their records

_FRAMES = "SELECT doc_id AS frame_id, sha2(concat('v', n_chars % 7), 256) AS fingerprint FROM {documents} d"
_HELD = "SELECT doc_id AS frame_id, sha2('v3', 256) AS fingerprint, CASE WHEN quality = 1 THEN 'answer' END AS response FROM {labels} l"


@query("SELECT count_if(state = 'hit') AS hit, count_if(state = 'failed') AS failed, count_if(state = 'stale') AS stale, count_if(state = 'miss') AS miss, count_if(state <> 'hit') AS needed, 100000 - (SELECT sum(coalesce(CASE WHEN o_custkey % 4 <> 3 THEN o_custkey % 4 END, 1)) FROM {orders}) AS \"left\" FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'miss' WHEN d.n_chars % 7 <> 3 THEN 'stale' WHEN l.quality = 1 THEN 'hit' ELSE 'failed' END AS state FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id) s")
def cache_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by what the cache holds of them, the calls needed and left."""
    stated = vision.cache_state(rows(spark, sf_dir, _FRAMES), rows(spark, sf_dir, _HELD))
    return vision.states(stated, rows(spark, sf_dir, "SELECT nullif(o_custkey % 4, 3) AS calls FROM {orders}"), 100_000)


@query("""SELECT count(*) AS records, round(count_if(ok) / count(*), 6) AS valid_share, round(count_if(ok AND good) / count_if(ok), 6) AS usable_share, sum(CASE WHEN ok THEN n ELSE 0 END) AS features, round(sum(CASE WHEN ok THEN n * 0.25 ELSE 0 END) / sum(CASE WHEN ok THEN n ELSE 0 END), 6) AS mean_confidence,
  round(sum(calls * p) / sum(calls), 6) AS mean_tokens_in, round(sum(calls * (q + 10)) / sum(calls), 6) AS mean_tokens_out, round(sum(calls * (p * 0.75 + (q + 10) * 3.75)) / 1000000 / sum(calls), 9) AS usd_per_call, 'stairs:' || sum(CASE WHEN ok THEN n ELSE 0 END) AS by_type FROM (
  SELECT o_orderstatus <> 'P' AS ok, o_custkey % 2 = 0 AS good, o_custkey % 3 AS n, o_custkey % 2 + 1 AS calls, o_custkey % 3000 AS p, o_orderkey % 600 AS q FROM {orders}) o""")
def run_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run of the model found and cost."""
    df = rows(spark, sf_dir, "SELECT o_orderstatus <> 'P' AS ok, o_custkey % 2 = 0 AS good, o_custkey % 3 AS n, o_custkey % 2 + 1 AS calls, o_custkey % 3000 AS p, o_orderkey % 600 AS q FROM {orders}")
    one = F.struct(F.lit("stairs").alias("type"), F.lit(0.25).alias("confidence"))
    answer = F.when(F.col("ok"), F.struct(F.col("good").alias("image_usable"), F.array_repeat(one, F.col("n").cast("int")).alias("features")))
    usage = F.array_repeat(F.struct(F.col("p").alias("prompt_tokens"), F.col("q").alias("output_tokens"), F.lit(10).alias("thinking_tokens")), F.col("calls").cast("int"))
    found = vision.run_summary(df.select(answer.alias("response"), usage.alias("usage")), 0.75, 3.75, 100).drop("usd_planned")
    found = found.withColumn("by_type", F.array_join(F.transform("by_type", lambda t: F.concat_ws(":", t["type"], t["n"].cast("string"))), ","))
    return found.select("records", "features", "by_type", *[F.round(c, 9 if c == "usd_per_call" else 6).alias(c) for c in ("valid_share", "usable_share", "mean_confidence", "mean_tokens_in", "mean_tokens_out", "usd_per_call")])


@query("SELECT l_orderkey AS id, l_linenumber AS k, l_quantity AS v FROM {lineitem} LEFT JOIN {orders} ON o_orderkey = l_orderkey AND o_orderstatus = 'F' WHERE o_orderkey IS NULL UNION ALL SELECT o_orderkey, 0, o_totalprice FROM {orders} WHERE o_orderstatus = 'F'")
def metrics_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after newer rows took the place of those with the same key."""
    held = rows(spark, sf_dir, "SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS k, CAST(l_quantity AS DOUBLE) AS v FROM {lineitem}")
    return sinks.upserted(held, rows(spark, sf_dir, "SELECT o_orderkey AS id, 0L AS k, CAST(o_totalprice AS DOUBLE) AS v FROM {orders} WHERE o_orderstatus = 'F'"), ["id"])


@query("SELECT o_orderpriority AS model, replace(replace(o_orderpriority || '/a:b', ':', '_'), '/', '_') AS folder, left(o_orderpriority, 2) = '1-' AS local, count(*) AS n FROM {orders} GROUP BY o_orderpriority")
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder names of models, and which run here."""
    df = rows(spark, sf_dir, "SELECT o_orderpriority AS model FROM {orders}").groupBy("model").agg(F.count("*").alias("n"))
    return df.select("model", vision.folder_name(F.concat("model", F.lit("/a:b"))).alias("folder"), vision.is_local(F.col("model"), "1-").alias("local"), "n")


_RUNNING = "SELECT a.o_orderkey AS id, CASE WHEN a.o_custkey % 4 = 3 THEN 1 ELSE a.o_custkey % 4 END AS calls FROM {orders} a"


@query(f"SELECT id, calls, running, running < 1001 AS granted FROM (SELECT id, calls, CAST(list_sum(list(calls) OVER (ORDER BY id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)) AS BIGINT) + coalesce(sum(calls) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 64 PRECEDING), 0) AS running FROM ({_RUNNING}) c) r")
def ledger_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running number of calls against the budget, without a window over all rows."""
    from ..operators import ordered

    calls = rows(spark, sf_dir, "SELECT o_orderkey AS id, coalesce(nullif(o_custkey % 4, 3), 1) AS calls FROM {orders}")
    return ordered.running(calls, [F.col("id")], F.col("calls"), "running").select("id", "calls", "running", (F.col("running") <= 1000).alias("granted"))


# feedback

_SENT = "SELECT event_id AS id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE concat('b', user_id % 50) END AS barrier_id, CASE WHEN event_id % 13 = 0 THEN 'maybe' WHEN event_type IN ('click', 'view') THEN 'confirm' ELSE 'reject' END AS verdict, CASE WHEN event_id % 19 = 0 THEN repeat('x', 501) ELSE concat(' said ', event_id) END AS comment, CASE WHEN event_id % 11 = 0 THEN '' ELSE concat(' ', user_id, ' , 10.0.0.1') END AS forwarded, ts AS created_at FROM {events}"


@query(f"SELECT id, CASE WHEN barrier_id IS NULL THEN 'id' WHEN verdict = 'maybe' THEN 'verdict' WHEN length(trim(comment)) > 500 THEN 'comment' WHEN barrier_id IN ('b7', 'b8') THEN 'unknown' END AS fault, sha256('salt:' || CASE WHEN forwarded = '' THEN 'unknown' ELSE trim(string_split(forwarded, ',')[1]) END) AS client, length(trim(comment)) AS chars FROM ({_SENT}) s")
def client_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions with what is wrong with them and the client's hash."""
    known = rows(spark, sf_dir, "SELECT DISTINCT concat('b', user_id % 50) AS barrier_id FROM {events} WHERE user_id % 50 NOT IN (7, 8)")
    return feedback.checked(rows(spark, sf_dir, _SENT), "salt", known).select("id", "fault", F.col("ip_hash").alias("client"), F.length("comment").alias("chars"))


_FEED = f"({own.FEEDBACK}) f"


@query(f"SELECT barrier_id, coalesce(confirm, 0) AS confirm, coalesce(reject, 0) AS reject, CASE sign(coalesce(confirm, 0) - coalesce(reject, 0)) WHEN 1 THEN 'confirmed' WHEN -1 THEN 'rejected' ELSE 'disputed' END AS status FROM (PIVOT (SELECT barrier_id, verdict FROM {_FEED}) ON verdict IN ('confirm', 'reject') USING count(*) GROUP BY barrier_id) p")
def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmations and rejections of each barrier."""
    return feedback.summary(rows(spark, sf_dir, f"SELECT * FROM {_FEED}"))


@query(f"SELECT a.id, count(b.id) AS n, count(b.id) >= 30 AS limited FROM {_FEED.replace(') f', ') a')} LEFT JOIN {_FEED.replace(') f', ') b')} ON b.ip_hash = a.ip_hash AND b.created_at <= a.created_at AND b.created_at >= a.created_at - INTERVAL 1 HOUR AND (b.created_at < a.created_at OR b.id <> a.id) GROUP BY a.id")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many submissions a client made in the hour before each, and whether that is too many."""
    return feedback.recent(rows(spark, sf_dir, f"SELECT * FROM {_FEED}")).select("id", "n", "limited")


@query("SELECT doc_id, toxic IS NOT DISTINCT FROM 1 AS flagged FROM {labels} l WHERE quality = 1 AND NOT EXISTS (SELECT 1 FROM {documents} d WHERE d.doc_id = l.doc_id AND d.n_chars < 300)")
def label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled frames without those held out, and which of them are flagged."""
    labelled = rows(spark, sf_dir, "SELECT doc_id, toxic FROM {labels} WHERE quality = 1")
    held = rows(spark, sf_dir, "SELECT doc_id FROM {documents} WHERE n_chars < 300")
    return labelled.join(held, "doc_id", "left_anti").select("doc_id", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("flagged"))


@query("SELECT p_partkey AS frame_id FROM {part} ORDER BY p_partkey LIMIT 25")
def first_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 frames by id, the limit of a trial run."""
    return imagery.first_frames(rows(spark, sf_dir, "SELECT p_partkey AS frame_id FROM {part}"), 25)
