"""Queries that decode score vectors, by position, into attributes, and small value formats.

The vectors are embeddings, activated by a steep sigmoid where they are read.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lumenframe.functions import vector as V
from lumenframe.sources.tables import table

#: Scores of a vector: a steep sigmoid of each value.
SCORES_SQL = "s AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: 1 / (1 + exp(-8 * x))) AS p FROM embeddings)"


def _scores(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform(V.doubles("embedding"), lambda x: V.sigmoid(x * 8)).alias("p"))


def at(i: int) -> str:
    """Score i, counted from 0."""
    return f"P{i}P"


def _render(text: str, spark: bool) -> str:
    return re.sub(r"P(\d+)P", lambda m: f"element_at(p, {int(m[1]) + 1})" if spark else f"p[{int(m[1]) + 1}]", text)


def first_max(names: list[str], start: int) -> str:
    """The name of the greatest of consecutive scores, the first of equal ones."""
    places = [at(start + i) for i in range(len(names))]
    best = f"greatest({', '.join(places)})"
    return "CASE " + " ".join(f"WHEN {p} = {best} THEN '{n}'" for n, p in zip(names, places, strict=True)) + " END"


def _greatest(start: int, n: int) -> str:
    return "greatest(" + ", ".join(at(start + i) for i in range(n)) + ")"


def flags(names: list[str], start: int, threshold: float, op: str = ">") -> str:
    """The names of consecutive scores over a threshold, each after a blank."""
    return "concat(" + ", ".join(f"CASE WHEN {at(start + i)} {op} {threshold} THEN ' {n}' ELSE '' END" for i, n in enumerate(names)) + ")"


#: Names by position, with thresholds .5, glasses .3 and held objects .6.
AGES, FACINGS, BAGS = ["AgeLess18", "Age18-60", "AgeOver60"], ["Front", "Side", "Back"], ["HandBag", "ShoulderBag", "Backpack"]
UPPER, LOWER = ["UpperStride", "UpperLogo", "UpperPlaid", "UpperSplice"], ["LowerStripe", "LowerPattern", "LongCoat", "Trousers", "Shorts", "Skirt&Dress"]
_LOWER_FLAGS = flags(LOWER, 8, 0.5)
PERSON = {
    "gender": f"CASE WHEN {at(22)} > 0.5 THEN 'Female' ELSE 'Male' END",
    "age": first_max(AGES, 19),
    "direction": first_max(FACINGS, 23),
    "glasses": f"{at(1)} > 0.3",
    "hat": f"{at(0)} > 0.5",
    "holds": f"{at(18)} > 0.6",
    "bag": f"CASE WHEN {_greatest(15, 3)} > 0.5 THEN {first_max(BAGS, 15)} ELSE 'No bag' END",
    "upper": f"concat(CASE WHEN {at(3)} > {at(2)} THEN 'LongSleeve' ELSE 'ShortSleeve' END, {flags(UPPER, 4, 0.5)})",
    "lower": f"CASE WHEN {_LOWER_FLAGS} = '' THEN concat(' ', {first_max(LOWER, 8)}) ELSE {_LOWER_FLAGS} END",
    "shoe": f"CASE WHEN {at(14)} > 0.5 THEN 'Boots' ELSE 'No boots' END",
    "output": "concat(" + ", ".join(f"CASE WHEN {at(i)} > {({1: 0.3, 18: 0.6}).get(i, 0.5)} THEN '1' ELSE '0' END" for i in range(26)) + ")",
}
#: The forty face labels in order; places 20 and 39 have a second name for their absence.
FACE_NAMES = (
    "CheekWhiskers ArchedEyebrows Attractive BagsUnderEyes Bald Bangs BigLips BigNose BlackHair BlondHair Blurry BrownHair BushyEyebrows Chubby DoubleChin "
    "Eyeglasses Goatee GrayHair HeavyMakeup HighCheekbones Male MouthSlightlyOpen Mustache NarrowEyes NoBeard OvalFace PaleSkin PointyNose RecedingHairline RosyCheeks "
    "Sideburns Smiling StraightHair WavyHair WearingEarrings WearingHat WearingLipstick WearingNecklace WearingNecktie Young"
).split()
ABSENT = {20: "Female", 39: "Old"}
FACE = {
    "attributes": "concat(" + ", ".join(f"CASE WHEN {at(i)} > 0.65 THEN ' {n}' ELSE '{' ' + ABSENT[i] if i in ABSENT else ''}' END" for i, n in enumerate(FACE_NAMES)) + ")",
    "output": "concat(" + ", ".join(f"CASE WHEN {at(i)} > 0.65 THEN '1' ELSE '0' END" for i in range(40)) + ")",
}
#: Six flags of a table's picture; the last two are tested against the threshold of the second.
TABLE_FLAGS = {"source": ("Scanned", "Photo"), "number": ("Little", "Numerous"), "color": ("Black-and-White", "Multicolor"), "clarity": ("Clear", "Blurry"), "obstruction": ("Without-Obstacles", "With-Obstacles"), "angle": ("Horizontal", "Tilted")}
TABLE = {n: f"CASE WHEN {at(i)} > 0.5 THEN '{yes}' ELSE '{no}' END" for i, (n, (yes, no)) in enumerate(TABLE_FLAGS.items())}
#: Thresholds of the attribute groups of 26 scores; flags by position.
PAR_FLAGS = {"hat": (0, 0.5), "glasses": (1, 0.4), "long_coat": (10, 0.5), "trousers": (11, 0.5), "shorts": (12, 0.5), "skirt": (13, 0.5), "boots": (14, 0.5), "hand_bag": (15, 0.5), "shoulder_bag": (16, 0.5), "backpack": (17, 0.5), "holds": (18, 0.5)}
PATTERNS = ["UpperStripe", "UpperLogo", "UpperPlaid", "UpperSplice", "LowerStripe", "LowerPattern"]
PAR = {
    **{n: f"{at(i)} >= {t}" for n, (i, t) in PAR_FLAGS.items()},
    "sleeve": f"CASE WHEN {_greatest(2, 2)} < 0.5 THEN 'Unknown' WHEN {at(2)} > {at(3)} THEN 'ShortSleeve' ELSE 'LongSleeve' END",
    "patterns": flags(PATTERNS, 4, 0.5, ">="),
    "age": f"CASE WHEN {_greatest(19, 3)} < 0.5 THEN 'Unknown' WHEN {at(19)} = {_greatest(19, 3)} THEN 'Age < 18' WHEN {at(21)} = {_greatest(19, 3)} THEN 'Age > 60' ELSE 'Age 18-60' END",
    "sex": f"CASE WHEN {at(22)} >= 0.6 THEN 'Female' WHEN 1 - {at(22)} >= 0.6 THEN 'Male' ELSE 'Unknown' END",
    "orientation": f"CASE WHEN {_greatest(23, 3)} < 0.5 THEN 'Unknown' ELSE {first_max(FACINGS, 23)} END",
}


def decoder(formulas: dict[str, str]):
    """A query of named formulas over a vector's scores, and its SQL."""

    def query(spark, d):
        return _scores(spark, d).selectExpr("vec_id", *[f"{_render(v, True)} AS {k}" for k, v in formulas.items()])

    return query, f"WITH {SCORES_SQL} SELECT vec_id, " + ", ".join(f"{_render(v, False)} AS {k}" for k, v in formulas.items()) + " FROM s"


person_decode, face_decode, table_decode, par_attributes = decoder(PERSON), decoder(FACE), decoder(TABLE), decoder(PAR)


def attribute_bag(spark, d):
    """One row for each attribute that is true or known."""
    x = par_attributes[0](spark, d)
    known = [F.when(F.col(n), F.struct(F.lit(n).alias("attribute"), F.lit("true").alias("value"))) for n in PAR_FLAGS]
    known += [F.when(F.col(n) != "Unknown", F.struct(F.lit(n).alias("attribute"), F.col(n).alias("value"))) for n in ("sleeve", "age", "sex", "orientation")]
    return x.select("vec_id", F.explode(F.array_compact(F.array(*known))).alias("a")).select("vec_id", "a.*")


BAG = f"WITH t AS ({par_attributes[1]}) " + " UNION ALL ".join([f"SELECT vec_id, '{n}' AS attribute, 'true' AS value FROM t WHERE {n}" for n in PAR_FLAGS] + [f"SELECT vec_id, '{n}' AS attribute, {n} AS value FROM t WHERE {n} <> 'Unknown'" for n in ("sleeve", "age", "sex", "orientation")])


def watch_decision(spark, d):
    """Wrist crops (either may be missing) and a model that may be missing: status, side and the greatest score over anchors."""
    x = _scores(spark, d).select(
        "vec_id", (F.col("vec_id") % 11 != 0).alias("model"),
        F.when(F.col("vec_id") % 3 != 0, F.array_max(F.slice("p", 1, 6))).alias("l"), F.when(F.col("vec_id") % 4 != 0, F.array_max(F.slice("p", 7, 6))).alias("r"),
    )
    return x.selectExpr("vec_id", f"{WATCH_STATUS} AS status", f"{WATCH_SIDE} AS side", "CASE WHEN model THEN round(greatest(coalesce(l, 0.0), coalesce(r, 0.0)), 4) ELSE 0.0 END AS confidence")


#: Fixed value: the least score of a watch.
WATCH_T = 0.50
WATCH_STATUS = f"CASE WHEN l IS NULL AND r IS NULL THEN 'NotVisible' WHEN NOT model THEN 'ModelUnavailable' WHEN coalesce(l, 0.0) >= {WATCH_T} OR coalesce(r, 0.0) >= {WATCH_T} THEN 'WatchDetected' ELSE 'NoWatchDetected' END"
WATCH_SIDE = f"CASE WHEN NOT model OR (l IS NULL AND r IS NULL) THEN NULL WHEN coalesce(l, 0.0) >= {WATCH_T} AND coalesce(r, 0.0) >= {WATCH_T} THEN 'Both' WHEN coalesce(l, 0.0) >= {WATCH_T} THEN 'Left' WHEN coalesce(r, 0.0) >= {WATCH_T} THEN 'Right' WHEN l IS NOT NULL AND r IS NOT NULL THEN 'Both inspected' WHEN l IS NOT NULL THEN 'Left inspected' ELSE 'Right inspected' END"
WATCH = f"""WITH {SCORES_SQL}, w AS (SELECT vec_id, vec_id % 11 <> 0 AS model, CASE WHEN vec_id % 3 <> 0 THEN list_max(list_slice(p, 1, 6)) END AS l, CASE WHEN vec_id % 4 <> 0 THEN list_max(list_slice(p, 7, 12)) END AS r FROM s)
SELECT vec_id, {WATCH_STATUS} AS status, {WATCH_SIDE} AS side, CASE WHEN model THEN round(greatest(coalesce(l, 0.0), coalesce(r, 0.0)), 4) ELSE 0.0 END AS confidence FROM w"""


def validity_counts(spark, d):
    """Valid and invalid vectors of each label, and how many labels there are."""
    e = table(spark, d, "embeddings").select("label", V.norm(V.doubles("embedding")).alias("n"))
    per = e.groupBy("label").agg(F.count_if(F.col("n") > 1e-6).alias("valid"), F.count_if(~(F.col("n") > 1e-6)).alias("invalid"))
    return per.join(F.broadcast(e.agg(F.countDistinct("label").alias("labels"))), F.lit(True))


VALID = "WITH e AS (SELECT label, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) SELECT label, count(*) FILTER (WHERE n > 1e-6) AS valid, count(*) FILTER (WHERE NOT n > 1e-6) AS invalid, (SELECT count(DISTINCT label) FROM e) AS labels FROM e GROUP BY label"

#: Mean and deviation of each colour channel.
CHANNELS = ((0.48145466, 0.26862954), (0.4578275, 0.26130258), (0.40821073, 0.27577711))


def channel_normalise(spark, d):
    """Three colour values of a part to the network's scale."""
    p = table(spark, d, "part")
    value = lambda i: F.col("p_partkey") * (31 + 6 * i) % 256
    return p.select("p_partkey", *[F.round((value(i) / 255.0 - m) / s + 1e-9, 5).alias(f"c{i}") for i, (m, s) in enumerate(CHANNELS)])


CHANNEL = "SELECT p_partkey, " + ", ".join(f"round((p_partkey * {31 + 6 * i} % 256 / 255.0::DOUBLE - {m}::DOUBLE) / {s}::DOUBLE + 1e-9, 5) AS c{i}" for i, (m, s) in enumerate(CHANNELS)) + " FROM part"


def score_text(spark, d):
    """Shares as whole per cents, scores with two places."""
    e = table(spark, d, "events").select("event_id", F.least(F.col("value") / 100.0, F.lit(1.0)).alias("q"))
    return e.select("event_id", F.concat(F.floor(F.col("q") * 100 + 0.5 + 1e-9).cast("string"), F.lit(" %")).alias("share"), F.format_string("%.2f", F.floor(F.col("q") * 100 + 0.5 + 1e-9) / 100).alias("score"))


TEXT = "WITH e AS (SELECT event_id, least(value / 100.0, 1.0::DOUBLE) AS q FROM events) SELECT event_id, concat(CAST(CAST(floor(q * 100 + 0.5 + 1e-9) AS BIGINT) AS VARCHAR), ' %') AS share, format('{:.2f}', CAST(floor(q * 100 + 0.5 + 1e-9) / 100 AS DOUBLE)) AS score FROM e"


def seeded_vector(spark, d):
    """A stand-in vector of each label, from digests of its name and places: the same in every run."""
    names = table(spark, d, "nation").select("n_name", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("dim"))
    unit = F.conv(F.substring(F.md5(F.concat("n_name", F.lit("/"), F.col("dim").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return names.select("n_name", F.col("dim").cast("long").alias("dim"), F.round(unit * 2 - 1, 6).alias("value"))


SEEDED = "SELECT n_name, dim, round(CAST(CAST('0x' || substr(md5(n_name || '/' || CAST(dim AS VARCHAR)), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0::DOUBLE * 2 - 1, 6) AS value FROM nation, range(8) t(dim)"

QUERIES = {
    "person_decode": person_decode,
    "face_decode": face_decode,
    "table_decode": table_decode,
    "par_attributes": par_attributes,
    "attribute_bag": (attribute_bag, BAG),
    "watch_decision": (watch_decision, WATCH),
    "validity_counts": (validity_counts, VALID),
    "channel_normalise": (channel_normalise, CHANNEL),
    "score_text": (score_text, TEXT),
    "seeded_vector": (seeded_vector, SEEDED),
}
