"""Queries for boxes, clustering and entities, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators import clustering as C
from sextant.operators import detection as D
from sextant.plans.search import total
from sextant.session import table

#: A neighbourhood in which the test vectors form core, border and noise points.
EPS = 0.66


def _faces(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as faces: image, confidence and label by arithmetic on the id."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("face_id"), (F.col("vec_id") % 97).alias("image_id"), "embedding", ((F.col("vec_id") * 37 % 101) / 101).alias("confidence"),
        F.when(F.col("vec_id") % 4 != 0, F.concat(F.lit("Name "), F.col("label").cast("string"))).alias("person_label"), F.when(F.col("vec_id") % 3 != 0, F.lit("t")).alias("thumbnail"), (F.col("label") - 1).alias("cluster_id"),
    )


_FACES_SQL = "(SELECT vec_id AS face_id, vec_id % 97 AS image_id, embedding::DOUBLE[] AS v, (vec_id * 37 % 101) / 101 AS confidence, CASE WHEN vec_id % 4 <> 0 THEN 'Name ' || label END AS person_label, CASE WHEN vec_id % 3 <> 0 THEN 't' END AS thumbnail, label - 1 AS cluster_id FROM embeddings)"


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as boxes on the picture of their order."""
    x, y = F.col("l_partkey") % 40, F.col("l_suppkey") % 30
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("box_id"), (F.col("l_quantity") / 50).alias("confidence"), x.cast("double").alias("l"), y.cast("double").alias("t"), (x + 30 + F.col("l_linenumber")).cast("double").alias("r"), (y + 40).cast("double").alias("b"))


_BOXES_SQL = "(SELECT l_orderkey AS image_id, l_linenumber AS box_id, l_quantity / 50 AS confidence, (l_partkey % 40)::DOUBLE AS l, (l_suppkey % 30)::DOUBLE AS t, (l_partkey % 40 + 30 + l_linenumber)::DOUBLE AS r, (l_suppkey % 30 + 40)::DOUBLE AS b FROM lineitem)"


def _box(prefix: str = ""):
    return D.box(*(F.col(prefix + c) for c in "ltrb"))


def iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    boxes = _boxes(spark, sf).select("image_id", "box_id", _box().alias("box"))
    other = boxes.select("image_id", F.col("box_id").alias("other_id"), F.col("box").alias("other"))
    return boxes.join(other, "image_id").filter("box_id < other_id").select("image_id", "box_id", "other_id", F.round(D.iou(F.col("box"), F.col("other")), 6).alias("iou"))


def nms(spark: SparkSession, sf: str) -> DataFrame:
    return D.suppress(_boxes(spark, sf)).select("image_id", "box_id")


def topn_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return D.top_per_image(_boxes(spark, sf), 3).select("image_id", "box_id", "rank")


def bbox_expand(spark: SparkSession, sf: str) -> DataFrame:
    grown = _boxes(spark, sf).select("image_id", "box_id", D.expand(*(F.col(c) for c in "ltrb"), F.lit(64.0), F.lit(64.0)).alias("e"))
    return grown.select("image_id", "box_id", *[F.round(f"e.{c}", 6).alias(c) for c in "ltrb"])


def anchor_decode(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), F.element_at(F.array(*map(F.lit, D.STRIDES)), (F.col("l_linenumber") % 3 + 1)).alias("stride"), (F.col("l_partkey") % 800).alias("anchor"), (F.col("l_quantity") / 10 - 2).alias("score"),
        (F.col("l_suppkey") % 7).alias("d_l"), (F.col("l_partkey") % 5).alias("d_t"), (F.col("l_suppkey") % 3 + 1).alias("d_r"), (F.col("l_partkey") % 4 + 1).alias("d_b"), F.lit(0.5).alias("scale"), F.lit(10.0).alias("pad_x"), F.lit(20.0).alias("pad_y"),
    )
    return D.decode_anchors(rows).select("image_id", "stride", "anchor", *[F.round(c, 6).alias(c) for c in ("confidence", "l", "t", "r", "b")])


def eps_join(spark: SparkSession, sf: str) -> DataFrame:
    return C.eps_join(_faces(spark, sf), EPS).select("a", "b", F.round("distance", 6).alias("distance"))


def core_points(spark: SparkSession, sf: str) -> DataFrame:
    return C.core_points(C.eps_join(_faces(spark, sf), EPS))


def dbscan(spark: SparkSession, sf: str) -> DataFrame:
    return C.dbscan(_faces(spark, sf), EPS)


def cluster_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return C.centroids(_faces(spark, sf)).select("cluster_id", "n", total(F.col("centroid")).alias("digest"))


def person_agg(spark: SparkSession, sf: str) -> DataFrame:
    return C.entities(_faces(spark, sf)).select("person_id", "label", "face_count", F.coalesce("cover_face", F.lit(-1)).alias("cover_face"), total(F.col("centroid")).alias("digest"))


def label_propagate(spark: SparkSession, sf: str) -> DataFrame:
    people = C.members(_faces(spark, sf))
    labels = people.select("person_id").distinct().filter("person_id % 2 = 0").withColumn("label", F.concat(F.lit("New "), F.col("person_id").cast("string")))
    return C.label_faces(people, labels).select("face_id", "person_id", "person_label")


def merge_entities(spark: SparkSession, sf: str) -> DataFrame:
    people = C.members(_faces(spark, sf))
    mapping = people.select(F.col("person_id").alias("from_id")).distinct().filter("from_id BETWEEN 1 AND 3").withColumn("to_id", F.lit(0).cast("long"))
    return C.centroids(C.merge_entities(people, mapping), "person_id").select("person_id", "n", total(F.col("centroid")).alias("digest"))


def nearest_centroid(spark: SparkSession, sf: str) -> DataFrame:
    faces = _faces(spark, sf)
    return C.nearest_centroid(faces, C.centroids(faces), 0.75).select("face_id", F.coalesce("cluster_id", F.lit(-2)).alias("cluster_id"), F.round("distance", 6).alias("distance"))


def search_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return C.search_by_label(_faces(spark, sf), "NAME 3")


def images_of_person(spark: SparkSession, sf: str) -> DataFrame:
    return C.images_of(C.members(_faces(spark, sf)))


def people_by_faces(spark: SparkSession, sf: str) -> DataFrame:
    return C.by_face_count(C.members(_faces(spark, sf)).groupBy("person_id").agg(F.count("*").alias("face_count")))


def face_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _faces(spark, sf).select(F.concat(F.lit("face_"), F.col("face_id").cast("string")).alias("face"), C.display_name(F.col("person_label"), F.col("cluster_id")).alias("name"))


QUERIES = {
    "iou_pairs": iou_pairs, "nms": nms, "topn_per_group": topn_per_group, "bbox_expand": bbox_expand, "anchor_decode": anchor_decode, "eps_join": eps_join, "core_points": core_points, "dbscan": dbscan,
    "cluster_centroid": cluster_centroid, "person_agg": person_agg, "label_propagate": label_propagate, "merge_entities": merge_entities, "nearest_centroid": nearest_centroid, "search_by_label": search_by_label,
    "images_of_person": images_of_person, "people_by_faces": people_by_faces, "face_ids": face_ids,
}

_WIDTH = "(least({a}r, {b}r) - greatest({a}l, {b}l))"
_HEIGHT = "(least({a}b, {b}b) - greatest({a}t, {b}t))"


def _iou(a: str, b: str) -> str:
    w, h = _WIDTH.format(a=a, b=b), _HEIGHT.format(a=a, b=b)
    common = f"CASE WHEN {w} > 0 AND {h} > 0 THEN {w} * {h} ELSE 0 END"
    union = f"(({a}r - {a}l) * ({a}b - {a}t) + ({b}r - {b}l) * ({b}b - {b}t) - {common})"
    return f"CASE WHEN {union} > 0 THEN ({common}) / {union} ELSE 0 END"


_PAIRS = f"pairs AS (SELECT x.face_id AS a, y.face_id AS b, 1 - list_inner_product(x.v, y.v) AS d FROM {_FACES_SQL} x, {_FACES_SQL} y WHERE x.face_id < y.face_id AND 1 - list_inner_product(x.v, y.v) <= {EPS})"
_CORE = "ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), core AS (SELECT a AS id, count(*) AS neighbours FROM ways GROUP BY a HAVING count(*) >= 2)"
_MEMBERS = f"members AS (SELECT *, CASE WHEN cluster_id <> -1 THEN cluster_id ELSE 10000 + row_number() OVER (PARTITION BY cluster_id ORDER BY face_id) - 1 END AS person_id FROM {_FACES_SQL})"


def _centroids(source: str, key: str) -> str:
    return f"""parts AS (SELECT {key}, unnest(v) AS x, unnest(range(64)) AS i FROM {source}), means AS (SELECT {key}, i, avg(x) AS x, count(*) AS n FROM parts GROUP BY ALL),
        cents AS (SELECT {key}, max(n) AS n, CASE WHEN max(n) = 1 THEN list(x ORDER BY i) ELSE list_transform(list(x ORDER BY i), lambda y: y / sqrt(sum(x * x))) END AS c FROM means GROUP BY {key})"""


_DIGEST = "round(list_sum(list_transform(c, lambda x, i: x * i)), 6) AS digest"

ORACLES = {
    "iou_pairs": f"SELECT x.image_id, x.box_id, y.box_id AS other_id, round({_iou('x.', 'y.')}, 6) AS iou FROM {_BOXES_SQL} x JOIN {_BOXES_SQL} y ON x.image_id = y.image_id AND x.box_id < y.box_id",
    "nms": f"""WITH RECURSIVE placed AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, box_id, l, t, r, b) AS place FROM {_BOXES_SQL}),
        walk AS (SELECT image_id, place, [{{'id': box_id, 'l': l, 't': t, 'r': r, 'b': b}}] AS kept FROM placed WHERE place = 1
            UNION ALL SELECT p.image_id, p.place, CASE WHEN len(list_filter(w.kept, lambda k: {_iou('k.', 'p.')} > 0.4)) > 0 THEN w.kept ELSE list_append(w.kept, {{'id': p.box_id, 'l': p.l, 't': p.t, 'r': p.r, 'b': p.b}}) END
            FROM walk w JOIN placed p ON p.image_id = w.image_id AND p.place = w.place + 1)
        SELECT image_id, k.id AS box_id FROM (SELECT image_id, unnest(kept) AS k FROM (SELECT image_id, arg_max(kept, place) AS kept FROM walk GROUP BY image_id))""",
    "topn_per_group": f"SELECT image_id, box_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, box_id)::INT AS rank FROM {_BOXES_SQL}) WHERE rank <= 3",
    "bbox_expand": f"""SELECT image_id, box_id, round(least(greatest(x - s / 2, 0), 64), 6) AS l, round(least(greatest(y - s / 2, 0), 64), 6) AS t, round(least(greatest(x + s / 2, 0), 64), 6) AS r, round(least(greatest(y + s / 2, 0), 64), 6) AS b
        FROM (SELECT image_id, box_id, greatest((r - l) * 1.3::DOUBLE, (b - t) * 1.3::DOUBLE) AS s, (l + r) / 2 AS x, (t + b) / 2 AS y FROM {_BOXES_SQL})""",
    "anchor_decode": """WITH rows AS (SELECT l_orderkey AS image_id, [8, 16, 32][l_linenumber % 3 + 1] AS stride, l_partkey % 800 AS anchor, l_quantity / 10 - 2 AS score, l_suppkey % 7 AS dl, l_partkey % 5 AS dt, l_suppkey % 3 + 1 AS dr, l_partkey % 4 + 1 AS db FROM lineitem),
        placed AS (SELECT *, CASE WHEN score < 0 OR score > 1 THEN 1 / (1 + exp(-score)) ELSE score END AS confidence, ((anchor // 2) % (640 // stride)) * stride AS x, ((anchor // 2) // (640 // stride)) * stride AS y FROM rows)
        SELECT image_id, stride, anchor, round(confidence, 6) AS confidence, round(greatest(0, (x - dl * stride - 10.0::DOUBLE) / 0.5), 6) AS l, round(greatest(0, (y - dt * stride - 20.0::DOUBLE) / 0.5), 6) AS t,
            round(greatest(0, (x + dr * stride - 10.0::DOUBLE) / 0.5), 6) AS r, round(greatest(0, (y + db * stride - 20.0::DOUBLE) / 0.5), 6) AS b FROM placed WHERE confidence >= 0.3""",
    "eps_join": f"WITH {_PAIRS} SELECT a, b, round(d, 6) AS distance FROM pairs",
    "core_points": f"WITH {_PAIRS}, {_CORE} SELECT id, neighbours FROM core",
    "dbscan": f"""WITH RECURSIVE {_PAIRS}, {_CORE}, inner_ways AS (SELECT a, b FROM ways WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
        reach(id, other) AS (SELECT id, id FROM core UNION SELECT r.id, w.b FROM reach r JOIN inner_ways w ON w.a = r.other),
        roots AS (SELECT id, min(other) AS root FROM reach GROUP BY id), numbers AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster_id FROM (SELECT DISTINCT root FROM roots)),
        clustered AS (SELECT id, cluster_id FROM roots JOIN numbers USING (root)), border AS (SELECT a AS id, min(cluster_id) AS cluster_id FROM ways JOIN clustered c ON c.id = ways.b WHERE a NOT IN (SELECT id FROM core) GROUP BY a)
        SELECT vec_id AS face_id, coalesce(cluster_id, -1)::INT AS cluster_id FROM embeddings LEFT JOIN (SELECT * FROM clustered UNION ALL SELECT * FROM border) f ON f.id = vec_id""",
    "cluster_centroid": f"WITH {_centroids(_FACES_SQL, 'cluster_id')} SELECT cluster_id, n, {_DIGEST} FROM cents",
    "person_agg": f"""WITH {_MEMBERS}, {_centroids("members", "person_id")}, summary AS (SELECT person_id, arg_min(person_label, face_id) FILTER (trim(person_label) <> '') AS label, count(*) AS face_count, arg_max(face_id, (confidence, -face_id)) FILTER (thumbnail IS NOT NULL) AS cover_face FROM members GROUP BY person_id)
        SELECT person_id, label, face_count, coalesce(cover_face, -1) AS cover_face, {_DIGEST} FROM summary JOIN cents USING (person_id)""",
    "label_propagate": f"WITH {_MEMBERS} SELECT face_id, person_id, CASE WHEN person_id % 2 = 0 THEN 'New ' || person_id ELSE person_label END AS person_label FROM members",
    "merge_entities": f"WITH {_MEMBERS}, merged AS (SELECT CASE WHEN person_id BETWEEN 1 AND 3 THEN 0 ELSE person_id END AS person_id, v FROM members), {_centroids('merged', 'person_id')} SELECT person_id, n, {_DIGEST} FROM cents",
    "nearest_centroid": f"""WITH {_centroids(_FACES_SQL, "cluster_id")}, best AS (SELECT face_id, arg_min(cluster_id, (1 - list_inner_product(v, c), cluster_id)) AS cluster_id, min(1 - list_inner_product(v, c)) AS d FROM (SELECT face_id, v FROM {_FACES_SQL}) f, cents GROUP BY face_id)
        SELECT face_id, CASE WHEN d < 0.75 THEN cluster_id ELSE -2 END AS cluster_id, CASE WHEN d < 0.75 THEN round(d, 6) END AS distance FROM best""",
    "search_by_label": f"SELECT DISTINCT image_id, 1.0::DOUBLE AS similarity FROM {_FACES_SQL} WHERE contains(lower(person_label), 'name 3')",
    "images_of_person": f"WITH {_MEMBERS} SELECT person_id, image_id, min(face_id) AS first_face FROM members GROUP BY ALL",
    "people_by_faces": f"WITH {_MEMBERS} SELECT person_id, count(*) AS face_count FROM members GROUP BY person_id",
    "face_ids": f"SELECT 'face_' || face_id AS face, CASE WHEN person_label IS NOT NULL THEN person_label WHEN cluster_id >= 0 THEN 'Person ' || cluster_id END AS name FROM {_FACES_SQL}",
}
