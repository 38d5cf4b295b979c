"""Image policy, model answers and signals, with metrics derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsontext as J, scalars as S
from ..operators import aggregates as A, images as I
from ..operators.signal import signal_features
from ..plans.jobs import image_batch
from .registry import query, scan, table

# Faces, size and sharpness of an "image" are read off its vector.
IMAGES_SQL = """src AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS e, label FROM embeddings),
img AS (SELECT doc_id, e, label, (600 + 4000 * abs(e[1]))::INT AS width, (500 + 3000 * abs(e[2]))::INT AS height,
  800 * abs(e[3]) AS blur_score, CASE WHEN label <> 3 THEN 900 * abs(e[4]) END AS face_blur_score,
  label <> 8 AS decodable, label <> 9 AS present,
  list_transform(range(label % 4), lambda i: {'x1': 40 * e[5 + 5 * i], 'y1': 30 * e[6 + 5 * i], 'x2': 40 * e[5 + 5 * i] + 900 * abs(e[7 + 5 * i]),
    'y2': 30 * e[6 + 5 * i] + 900 * abs(e[8 + 5 * i]), 'score': least(0.99, 0.3 + 4 * abs(e[9 + 5 * i])), 'n': i}) AS faces FROM src),
big AS (SELECT *, list_max(list_transform(faces, lambda f: (f.x2 - f.x1) * (f.y2 - f.y1))) AS area FROM img),
face AS (SELECT *, list_filter(faces, lambda f: (f.x2 - f.x1) * (f.y2 - f.y1) = area)[1] AS f,
  CASE WHEN greatest(width, height) <= 1024 THEN width ELSE greatest(1, round_even(width * (1024.0::DOUBLE / greatest(width, height)), 0))::INT END AS rw,
  CASE WHEN greatest(width, height) <= 1024 THEN height ELSE greatest(1, round_even(height * (1024.0::DOUBLE / greatest(width, height)), 0))::INT END AS rh FROM big),
metric AS (SELECT *, len(faces) AS face_count, coalesce(f.score, 0) AS face_score, coalesce(greatest(0, area) / (rw::DOUBLE * rh), 0) AS ratio FROM face),
flag AS (SELECT *, face_count > 0 AND face_score >= 0.5 AND ratio >= 0.01 AS has_face, blur_score < 100 AS is_blurry FROM metric),
flag2 AS (SELECT *, has_face AND coalesce(face_blur_score < 80, false) AS is_face_blurry FROM flag),
ruled AS (SELECT *, face_count = 1 AND has_face AND ratio >= 0.03 AND NOT is_blurry AND NOT is_face_blurry AS is_avatar,
  concat_ws('；', CASE WHEN NOT has_face THEN '未检测到有效人脸' WHEN face_count <> 1 THEN '头像必须恰好包含一张人脸' END,
    CASE WHEN has_face AND ratio < 0.03 THEN '人脸占画面比例过小' END, CASE WHEN is_blurry THEN '整张图片明显模糊' END,
    CASE WHEN is_face_blurry THEN '人脸区域明显模糊' END) AS why FROM flag2),
ready AS (SELECT *, CASE WHEN why = '' THEN '单人脸清晰且占比合理' ELSE why END AS analysis_reason FROM ruled),
outcome AS (SELECT *, CASE WHEN NOT present THEN 'download_failed' WHEN NOT decodable THEN 'decode_failed' ELSE 'ok' END AS analysis_status FROM ready)"""


def image_rows(spark, d):
    rows = table(spark, d, "embeddings")
    e = lambda i: F.element_at(F.col("e"), i)
    src = rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("e"), "label")

    def face(i):
        at = lambda n: F.element_at(F.col("e"), F.lit(n) + 5 * i)
        return F.struct(
            (40 * at(5)).alias("x1"), (30 * at(6)).alias("y1"),
            (40 * at(5) + 900 * F.abs(at(7))).alias("x2"), (30 * at(6) + 900 * F.abs(at(8))).alias("y2"),
            F.least(F.lit(0.99), F.lit(0.3) + 4 * F.abs(at(9))).alias("score"),
        )

    n = F.col("label") % 4
    numbers = F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), n)
    label = F.col("label")
    return src.select(
        "doc_id", "e", "label",
        F.bround(600 + 4000 * F.abs(e(1)), 0).cast("int").alias("width"),
        F.bround(500 + 3000 * F.abs(e(2)), 0).cast("int").alias("height"),
        (800 * F.abs(e(3))).alias("blur_score"),
        F.when(label != 3, 900 * F.abs(e(4))).alias("face_blur_score"),
        (label != 8).alias("decodable"),
        F.when(label != 9, F.lit(bytearray(b"jpeg"))).alias("image_blob"),
        F.transform(numbers, face).alias("faces"),
    )


@query("largest_face", f"""WITH {IMAGES_SQL} SELECT doc_id, round(f.x1, 5) AS x1, round(f.y2, 5) AS y2, round(f.score, 6) AS score FROM face""")
def largest_face(spark, d):
    best = image_rows(spark, d).select("doc_id", I.largest_face(F.col("faces")).alias("f"))
    return best.select("doc_id", F.round("f.x1", 5).alias("x1"), F.round("f.y2", 5).alias("y2"), F.round("f.score", 6).alias("score"))


@query("avatar_rules", f"""WITH {IMAGES_SQL} SELECT doc_id, face_count::INT AS face_count, round(face_score, 6) AS face_score, round(ratio, 6) AS face_area_ratio,
has_face, is_blurry, is_face_blurry, is_avatar, analysis_reason FROM ready""")
def avatar_rules(spark, d):
    out = I.avatar_rules(image_rows(spark, d))
    return out.select(
        "doc_id", "face_count", F.round("face_score", 6).alias("face_score"), F.round("face_area_ratio", 6).alias("face_area_ratio"),
        "has_face", "is_blurry", "is_face_blurry", "is_avatar", "analysis_reason",
    )


@query("resized_dims", f"WITH {IMAGES_SQL} SELECT doc_id, rw::INT AS width, rh::INT AS height FROM face")
def resized_dims(spark, d):
    return image_rows(spark, d).select("doc_id", I.resized_dims(F.col("width"), F.col("height")).alias("s")).select("doc_id", "s.*")


@query("clip_box", f"""WITH {IMAGES_SQL}, c AS (SELECT doc_id, greatest(0, trunc(f.x1))::INT AS x1, greatest(0, trunc(f.y1))::INT AS y1,
least(300, trunc(f.x2))::INT AS x2, least(200, trunc(f.y2))::INT AS y2 FROM face), k AS (SELECT *, coalesce(x2 > x1 AND y2 > y1, false) AS keep FROM c)
SELECT doc_id, CASE WHEN keep THEN x1 END AS x1, CASE WHEN keep THEN y1 END AS y1, CASE WHEN keep THEN x2 END AS x2, CASE WHEN keep THEN y2 END AS y2 FROM k""")
def clip_box(spark, d):
    faces = image_rows(spark, d).select("doc_id", I.largest_face(F.col("faces")).alias("f"))
    return faces.select("doc_id", I.clip_box(F.col("f"), F.lit(300), F.lit(200)).alias("b")).select("doc_id", "b.*")


@query("image_batch_local", f"""WITH {IMAGES_SQL} SELECT doc_id, analysis_status, CASE analysis_status WHEN 'download_failed' THEN '图片不存在' WHEN 'decode_failed' THEN '图片无法解码' END AS analysis_error,
'local' AS analysis_backend, CASE WHEN analysis_status = 'ok' THEN is_avatar END AS is_avatar, CASE WHEN analysis_status = 'ok' THEN width END AS width,
CASE WHEN analysis_status = 'ok' THEN analysis_reason END AS analysis_reason, NULL::DOUBLE AS avatar_confidence FROM outcome""")
def image_batch_local(spark, d):
    return image_batch(image_rows(spark, d)).select(
        "doc_id", "analysis_status", "analysis_error", "analysis_backend", "is_avatar", "width", "analysis_reason", "avatar_confidence"
    )


def _embedded(spark, d):
    done = image_batch(image_rows(spark, d))
    vector = F.when(F.col("label") == 7, F.slice("e", 1, 5)).otherwise(F.col("e"))
    return I.embedding_status(done.withColumn("image_embedding", vector), "clip", 64)


EMBEDDED_SQL = """embedded AS (SELECT *, CASE WHEN NOT present THEN 'skipped' WHEN NOT decodable OR label = 7 THEN 'failed' ELSE 'ok' END AS embedding_status,
CASE WHEN analysis_status = 'ok' THEN is_avatar END AS avatar FROM outcome)"""


@query("embedding_status", f"WITH {IMAGES_SQL}, {EMBEDDED_SQL} SELECT doc_id, embedding_status, embedding_status = 'ok' AS has_vector FROM embedded")
def embedding_status(spark, d):
    out = _embedded(spark, d)
    return out.select("doc_id", "embedding_status", F.col("image_embedding").isNotNull().alias("has_vector"))


def _summary_sql(fine: str) -> str:
    return f"""WITH {IMAGES_SQL}, {EMBEDDED_SQL}, s AS (SELECT *, CASE WHEN label = 5 THEN 'pending' WHEN label <> 4 THEN analysis_status END AS st,
CASE WHEN label NOT IN (4, 5) THEN avatar END AS av FROM embedded)
SELECT count(*) AS total, count(*) FILTER (WHERE st = 'ok') AS analyzed, count(*) FILTER (WHERE av) AS avatars, count(*) FILTER (WHERE NOT av) AS rejected,
count(*) FILTER (WHERE st NOT IN ({fine})) AS failed, count(*) FILTER (WHERE embedding_status = 'ok') AS embedded FROM s"""


def _mixed(spark, d):
    label = F.col("label")
    return _embedded(spark, d).withColumns(
        {
            "analysis_status": F.when(label == 5, "pending").when(label != 4, F.col("analysis_status")),
            "is_avatar": F.when(~label.isin(4, 5), F.col("is_avatar")),
        }
    )


@query("image_summary", _summary_sql("'pending', 'ok'"))
def image_summary(spark, d):
    return A.image_summary(_mixed(spark, d))


@query("image_summary_ui", _summary_sql("'ok'"))
def image_summary_ui(spark, d):
    return A.image_summary(_mixed(spark, d), pending_is_failure=True)


@query("image_stage_counters", f"""WITH {IMAGES_SQL}, {EMBEDDED_SQL} SELECT count(*) FILTER (WHERE NOT present) AS missing, count(*) FILTER (WHERE analysis_status = 'ok') AS ok,
count(*) FILTER (WHERE analysis_status <> 'ok') AS failed, count(*) FILTER (WHERE avatar) AS avatars, count(*) FILTER (WHERE embedding_status = 'ok') AS embedded,
count(*) FILTER (WHERE embedding_status = 'failed') AS embed_failed FROM embedded""")
def image_stage_counters(spark, d):
    return A.image_stage_counters(_embedded(spark, d))


CONFUSION = f"""WITH {IMAGES_SQL}, c AS (SELECT label = 1 AS expected_avatar, is_avatar, count(*) AS images FROM outcome WHERE analysis_status = 'ok' AND label <> 2 GROUP BY 1, 2)"""


def _confusion(spark, d):
    labels = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.when(F.col("label") != 2, F.col("label") == 1).alias("expected_avatar")
    )
    return I.label_accuracy(image_batch(image_rows(spark, d)), labels)


@query("label_accuracy", f"{CONFUSION} SELECT * FROM c")
def label_accuracy(spark, d):
    return _confusion(spark, d)


@query("label_accuracy_rate", f"""{CONFUSION} SELECT sum(CASE WHEN expected_avatar = is_avatar THEN images ELSE 0 END)::BIGINT AS correct, sum(images)::BIGINT AS total,
round(sum(CASE WHEN expected_avatar = is_avatar THEN images ELSE 0 END) / sum(images), 6) AS accuracy FROM c""")
def label_accuracy_rate(spark, d):
    return I.accuracy(_confusion(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


@query("laplacian_variance", """WITH px AS (SELECT vec_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, embedding[i]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)),
n AS (SELECT vec_id, v, lag(v) OVER r AS l, lead(v) OVER r AS rt, lag(v) OVER c AS u, lead(v) OVER c AS dn FROM px
  WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y))
SELECT vec_id, round(var_pop(coalesce(l, rt) + coalesce(rt, l) + coalesce(u, dn) + coalesce(dn, u) - 4 * v), 6) AS blur_score FROM n GROUP BY vec_id""")
def laplacian_variance(spark, d):
    pixels = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "luma"))
    pixels = pixels.select("vec_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"), "luma")
    return I.laplacian_variance(pixels, "vec_id").withColumn("blur_score", F.round("blur_score", 6))


# ---- model answers -----------------------------------------------------------------------

# Answers of a vision model, right and wrong, one kind per event.
ANSWER_SQL = """answers AS (SELECT event_id, user_id % 10 AS kind, '{"has_face": ' || (CASE WHEN user_id % 10 = 5 THEN 'false' ELSE 'true' END) ||
', "is_blurry": false, "is_face_blurry": false, "is_avatar": ' || (CASE WHEN user_id % 10 = 3 THEN '"true"' ELSE 'true' END) ||
', "clarity_confidence": ' || (CASE WHEN user_id % 10 = 4 THEN '1.5' ELSE '0.5' END) || ', "avatar_confidence": 1' ||
(CASE WHEN user_id % 10 = 1 THEN '' ELSE ', "reason": ' || (CASE WHEN user_id % 10 = 6 THEN '"  "' WHEN user_id % 10 = 7 THEN '12' ELSE '" ok "' END) END) ||
(CASE WHEN user_id % 10 = 2 THEN ', "more": 1' ELSE '' END) || '}' AS t FROM events)"""


def answer_rows(spark, d):
    kind = F.col("user_id") % 10
    bit = lambda on, yes, no: F.when(kind == on, F.lit(yes)).otherwise(F.lit(no))
    text = F.concat(
        F.lit('{"has_face": '), bit(5, "false", "true"),
        F.lit(', "is_blurry": false, "is_face_blurry": false, "is_avatar": '), bit(3, '"true"', "true"),
        F.lit(', "clarity_confidence": '), bit(4, "1.5", "0.5"), F.lit(', "avatar_confidence": 1'),
        F.when(kind == 1, "").otherwise(
            F.concat(F.lit(', "reason": '), F.when(kind == 6, '"  "').when(kind == 7, "12").otherwise('" ok "'))
        ),
        bit(2, ', "more": 1', ""), F.lit("}"),
    )
    return scan(spark, d, "events", "event_id", "user_id").select("event_id", kind.alias("kind"), text.alias("t"))


@query("response_contract", f"""WITH {ANSWER_SQL} SELECT event_id, CASE WHEN kind = 9 THEN 'not_object' WHEN kind IN (1, 2) THEN 'fields' WHEN kind = 3 THEN 'boolean' WHEN kind = 4 THEN 'number'
WHEN kind = 5 THEN 'contradiction' WHEN kind IN (6, 7) THEN 'reason' END AS error, CASE WHEN kind IN (0, 8) THEN json_extract_string(t, '$.clarity_confidence')::DOUBLE END AS clarity,
CASE WHEN kind IN (0, 8) THEN trim(json_extract_string(t, '$.reason')) END AS reason FROM answers""")
def response_contract(spark, d):
    rows = answer_rows(spark, d)
    fenced = F.when(F.col("kind") == 8, F.concat(F.lit("```json\n"), F.col("t"), F.lit("\n```")))
    text = fenced.when(F.col("kind") == 9, F.concat(F.lit("["), F.col("t"), F.lit("]"))).otherwise(F.col("t"))
    out = rows.select("event_id", J.validate_response(text).alias("v"))
    return out.select(
        "event_id", "v.error", F.col("v.value.clarity_confidence").alias("clarity"), F.col("v.value.reason").alias("reason")
    )


@query("image_batch_vlm", f"""WITH {ANSWER_SQL} SELECT event_id AS doc_id, CASE WHEN kind IN (0, 8, 9) THEN 'ok' ELSE 'llm_failed' END AS analysis_status, CASE WHEN kind IN (0, 8, 9) THEN true END AS is_avatar,
CASE WHEN kind IN (0, 8, 9) THEN 0.5::DOUBLE END AS clarity_confidence, NULL::DOUBLE AS face_score, 'vlm' AS analysis_backend FROM answers""")
def image_batch_vlm(spark, d):
    rows = answer_rows(spark, d).select(
        F.col("event_id").alias("doc_id"), F.col("t").alias("answer"), F.lit(True).alias("decodable"),
        F.lit(bytearray(b"jpeg")).alias("image_blob"), F.lit(10).alias("width"), F.lit(10).alias("height"),
        F.lit(0.0).alias("blur_score"), F.lit(0.0).alias("face_blur_score"),
    )
    return image_batch(rows, "vlm").select(
        "doc_id", "analysis_status", "is_avatar", "clarity_confidence", "face_score", "analysis_backend"
    )


def _wrapped(spark, d):
    kind, props = F.col("event_type"), F.col("props")
    text = (
        F.when(kind == "signup", F.concat(F.lit("```json\n"), props, F.lit("\n```")))
        .when(kind == "view", F.concat(F.lit("Sure: "), props, F.lit(" bye")))
        .when(kind == "error", F.concat(F.lit("{"), props))
        .when(kind == "click", F.concat(F.lit("["), props, F.lit("]")))
        .otherwise(props)
    )
    return scan(spark, d, "events", "event_id", "event_type", "props").select("event_id", text.alias("raw"))


@query("json_rescue", """SELECT event_id, CASE WHEN event_type <> 'error' THEN CASE WHEN event_type = 'click' THEN '[' || props || ']' ELSE props END END AS json FROM events""")
def json_rescue(spark, d):
    return _wrapped(spark, d).select("event_id", J.rescue_json(F.col("raw")).alias("json"))


@query("strict_json", """SELECT event_id, CASE WHEN event_type IN ('signup', 'purchase') THEN props END AS json FROM events""")
def strict_json(spark, d):
    return _wrapped(spark, d).select("event_id", J.strict_json(F.col("raw")).alias("json"))


@query("json_struct", """SELECT event_id, CASE WHEN event_type = 'purchase' THEN json_extract_string(props, '$.k')::BIGINT END AS k,
event_type = 'purchase' AS parsed FROM events""")
def json_struct(spark, d):
    from pyspark.sql.types import StructType

    parsed = _wrapped(spark, d).select("event_id", J.parse_struct(F.col("raw"), StructType.fromDDL("k bigint")).alias("s"))
    return parsed.select("event_id", F.col("s.k").alias("k"), F.col("s").isNotNull().alias("parsed"))


@query("rendered_values", """SELECT page_id, url, CAST(ts AS VARCHAR) AS seen, html FROM (SELECT page_id, url, DATE '2024-01-01' + (page_id % 28)::INT AS ts, md5(html) AS html FROM pages)""")
def rendered_values(spark, d):
    rows = table(spark, d, "pages").select(
        "page_id", F.col("url").cast("binary").alias("url"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 28).cast("int")).alias("seen"),
        F.md5("html").alias("html"),
    )
    return S.rendered(rows)


# ---- signals -----------------------------------------------------------------------------


@query("signal_features", """WITH s AS (SELECT event_type AS signal_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, value - 30 AS v FROM events),
n AS (SELECT signal_id, count(*) AS n, max(abs(v)) AS peak FROM s GROUP BY 1),
b AS (SELECT s.signal_id, i, v / peak AS v, CASE WHEN i < (n % 64) * (n // 64 + 1) THEN i // (n // 64 + 1) ELSE (n % 64) + (i - (n % 64) * (n // 64 + 1)) // greatest(n // 64, 1) END AS k FROM s JOIN n ON s.signal_id = n.signal_id),
z AS (SELECT *, (v < 0) <> (lag(v) OVER (PARTITION BY signal_id, k ORDER BY i) < 0) AS c FROM b),
f AS (SELECT signal_id, k, sqrt(avg(v * v)) AS rms, coalesce(avg(c::INT), 0) AS zcr FROM z GROUP BY 1, 2),
a AS (SELECT signal_id, k AS p, rms AS x FROM f UNION ALL SELECT signal_id, k + 64, zcr FROM f)
SELECT signal_id, p::BIGINT AS position, round(x / sqrt(sum(x * x) OVER (PARTITION BY signal_id)), 5) AS value FROM a""")
def event_signal(spark, d):
    out = signal_features(event_samples(table(spark, d, "events")), "signal_id", "idx", "v")
    exploded = out.select("signal_id", F.posexplode("features").alias("p", "x"))
    return exploded.select("signal_id", F.col("p").cast("bigint").alias("position"), F.round(F.col("x").cast("double"), 5).alias("value"))


def event_samples(events):
    """Events of one type as a signal, numbered without gaps.

    The number of a row is its rank within a stretch of 1000 ids, plus the rows of the stretches
    before in a thousand of them, plus those of the thousands before: no window sees more than a
    thousand rows, or one of a million ids.
    """
    from pyspark.sql import Window

    rows = events.select(
        F.col("event_type").alias("signal_id"), "event_id", (F.col("value") - 30).alias("v"),
        F.floor(F.col("event_id") / 1000).alias("_part"),
    )
    sizes = rows.groupBy("signal_id", "_part").agg(F.count("*").alias("_n")).withColumn("_top", F.floor(F.col("_part") / 1000))
    tops = sizes.groupBy("signal_id", "_top").agg(F.sum("_n").alias("_m"))
    earlier = lambda order, *group: Window.partitionBy("signal_id", *group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("signal_id", "_top", F.coalesce(F.sum("_m").over(earlier("_top")), F.lit(0)).alias("_base"))
    local = sizes.withColumn("_local", F.coalesce(F.sum("_n").over(earlier("_part", "_top")), F.lit(0)))
    starts = local.join(tops, ["signal_id", "_top"]).select("signal_id", "_part", (F.col("_base") + F.col("_local")).alias("_start"))
    within = Window.partitionBy("signal_id", "_part").orderBy("event_id")
    numbered = rows.withColumn("_r", F.row_number().over(within) - 1).join(starts, ["signal_id", "_part"])
    return numbered.select("signal_id", (F.col("_start") + F.col("_r")).alias("idx"), "v")
