"""Queries over text: cleaning, tokens, checksums, prompts, file names and upload validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import text as T
from lumenframe.functions.text import ascii_lower
from lumenframe.sources.tables import IMAGE_TYPES, VIDEO_TYPES, table


def _texts(spark, d):
    """(source, id, text) of documents and benchmark items."""
    docs, items = table(spark, d, "documents").select(F.lit("d").alias("source"), F.col("doc_id").alias("id"), "text"), table(spark, d, "benchmark")
    return docs.union(items.select(F.lit("b"), F.col("item_id"), "text")).where("text IS NOT NULL")


TEXTS = "t AS (SELECT 'd' AS source, doc_id AS id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'b', item_id, text FROM benchmark WHERE text IS NOT NULL)"


def text_clean(spark, d):
    """Documents and benchmark items with their white space cleaned."""
    rows = _texts(spark, d).select("source", "id", T.clean(F.concat(F.lit("  \t"), "text", F.lit("\n  x "))).alias("c"))
    return rows.select("source", "id", F.sha2("c", 256).alias("sha"), F.char_length("c").cast("long").alias("n"))


CLEAN = rf"""WITH {TEXTS}, c AS (SELECT source, id, trim(regexp_replace('  ' || chr(9) || text || chr(10) || '  x ', '[ \t\n\r\f\v]+', ' ', 'g')) AS c FROM t) SELECT source, id, sha256(c) AS sha, length(c) AS n FROM c"""

#: Fixed pattern of word pieces: runs of letters, single digits, runs of other marks.
PIECES = r"[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+"


def word_tokenize(spark, d):
    """Pieces of lower-cased texts, counted by piece; the vocabulary stage of a tokenizer."""
    docs = _texts(spark, d).select(F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(PIECES), F.lit(0))).alias("piece"))
    return docs.groupBy("piece").agg(F.count("*").alias("n"))


TOKENS = rf"WITH {TEXTS} SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+')) AS piece FROM t) GROUP BY 1"

#: Ids of the frame's ends and of the commonest words; other words get an id from their digest.
FRAME, KNOWN = (49406, 49407, 77), {"the": 518, "of": 539, "and": 537, "to": 531, "in": 530, "is": 533, "a": 320}


def word_ids(spark, d):
    """Ids of whole words, framed by a start and an end and filled with zeros to a fixed length; words beyond it are left out."""
    words = F.filter(F.split(ascii_lower(F.col("text")), "[ ,.;!?]"), lambda w: w != "")
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    other = lambda w: (F.lit(1000) + F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long") % 40000).cast("long")
    ids = F.transform(F.slice(words, 1, FRAME[2] - 2), lambda w: F.coalesce(F.try_element_at(known, w).cast("long"), other(w)))
    ids = F.concat(F.array(F.lit(FRAME[0]).cast("long")), ids, F.array(F.lit(FRAME[1]).cast("long")))
    filled = F.concat(ids, F.array_repeat(F.lit(0).cast("long"), FRAME[2] - F.size(ids)))
    return table(spark, d, "benchmark").select("item_id", filled.alias("ids")).select("item_id", F.size("ids").cast("long").alias("n"), F.array_join("ids", " ").alias("ids"))


WORD_IDS = f"""WITH w AS (SELECT item_id, list_slice(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ ,.;!?]'), lambda x: x <> ''), 1, {FRAME[2] - 2}) AS w FROM benchmark),
i AS (SELECT item_id, list_concat([{FRAME[0]}::BIGINT], list_transform(w, lambda x: CASE x {' '.join(f"WHEN '{k}' THEN {v}" for k, v in KNOWN.items())} ELSE 1000 + CAST('0x' || substr(md5(x), 1, 7) AS BIGINT) % 40000 END), [{FRAME[1]}::BIGINT]) AS i FROM w)
SELECT item_id, {FRAME[2]}::BIGINT AS n, array_to_string(list_concat(i, list_transform(range({FRAME[2]} - len(i)), lambda x: 0)), ' ') AS ids FROM i"""


def checksum(spark, d):
    """A checksum of each brand's part names in any order, from sums of digests: what guards a cache against changed content."""
    digest = F.md5(F.concat_ws(":", "p_name", F.col("p_size").cast("string")))
    half = lambda at: F.sum(F.conv(F.substring(digest, at, 8), 16, 10).cast("long"))
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), half(1).alias("low"), half(9).alias("high"))


CHECKSUM = """WITH m AS (SELECT p_brand, md5(p_name || ':' || p_size) AS m FROM part)
SELECT p_brand, count(*) AS n, CAST(sum(CAST('0x' || substr(m, 1, 8) AS BIGINT)) AS BIGINT) AS low, CAST(sum(CAST('0x' || substr(m, 9, 8) AS BIGINT)) AS BIGINT) AS high FROM m GROUP BY 1"""

#: Fixed templates of prompts.
TEMPLATES = ["a photo of a person wearing {0}", "a close-up of {0}", "an image of {0} clothing"]


def prompt_expand(spark, d):
    """Every name in every template."""
    names = table(spark, d, "part").select("p_name").distinct()
    out = names.select("p_name", F.posexplode(F.array(*[F.lit(t) for t in TEMPLATES])).alias("k", "template"))
    return out.select("p_name", F.col("k").cast("long").alias("k"), F.replace("template", F.lit("{0}"), F.col("p_name")).alias("prompt"))


PROMPTS = "SELECT p_name, t.k, replace(t.t, '{0}', p_name) AS prompt FROM (SELECT DISTINCT p_name FROM part), (VALUES " + ", ".join(f"({i}::BIGINT, '{t}')" for i, t in enumerate(TEMPLATES)) + ") t(k, t)"


def split_first_token(spark, d):
    first, rest = T.first_token(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", first.alias("first"), rest.alias("rest"))


SPLIT = "SELECT p_partkey, string_split(p_name, ' ')[1] AS first, array_to_string(list_slice(string_split(p_name, ' '), 2, 99), ' ') AS rest FROM part"


#: Brands that go by another name than their files.
BRAND_ALIASES = {"small": "House Small", "large": "House Large", "economy": "Eco"}


def brand_prefix(spark, d):
    """The brand before the first mark of an exemplar's file name, or its alias."""
    file = F.concat(F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".png"))
    raw = F.lower(F.regexp_extract(file, r"^([^_.\-]+)", 1))
    known = F.create_map(*[F.lit(x) for pair in BRAND_ALIASES.items() for x in pair])
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.try_element_at(known, raw), raw).alias("brand"))


BRANDS = "SELECT p_partkey, CASE b " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BRAND_ALIASES.items()) + r" ELSE b END AS brand FROM (SELECT p_partkey, lower(regexp_extract(replace(p_type, ' ', '_') || '_' || p_partkey || '.png', '^([^_.\-]+)', 1)) AS b FROM part)"


def ext_mime_rules(spark, d):
    """Names by extension and claimed type: the first rule that fails, or ok."""
    known = F.create_map(*[F.lit(x) for pair in (IMAGE_TYPES | VIDEO_TYPES).items() for x in pair])
    kinds = F.array(*[F.lit(x) for x in (".jpg", ".png", ".gif", ".mp4", ".JPEG")])
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("f"), "page_id", F.get(kinds, (F.col("page_id") % 5).cast("int"))).alias("name"), F.when(F.col("page_id") % 3 == 0, "image/png").otherwise("image/jpeg").alias("mime"), F.octet_length("html").alias("size"))
    p = p.withColumn("want", F.try_element_at(known, T.extension(F.col("name"))))
    return p.select("page_id", F.when(F.col("size") == 0, "empty").when(F.col("size") > 20_000, "too large").when(F.col("want").isNull(), "extension").when(F.col("want") != F.col("mime"), "type").otherwise("ok").alias("verdict"))


MIME = """WITH p AS (SELECT page_id, (page_id % 5)::INT AS e, CASE WHEN page_id % 3 = 0 THEN 'image/png' ELSE 'image/jpeg' END AS mime, strlen(html) AS size FROM pages),
w AS (SELECT *, ['image/jpeg', 'image/png', NULL, 'video/mp4', 'image/jpeg'][e + 1] AS want FROM p)
SELECT page_id, CASE WHEN size = 0 THEN 'empty' WHEN size > 20000 THEN 'too large' WHEN want IS NULL THEN 'extension' WHEN want <> mime THEN 'type' ELSE 'ok' END AS verdict FROM w"""


def magic_byte_validate(spark, d):
    """Uploads by their first bytes, and a preview as text; uploads are the pages, some behind the head of an image."""
    heads = F.array(F.lit("ffd8ffe0"), F.lit("89504e47"), F.lit("47494638"), F.lit(""))
    p = table(spark, d, "pages").select("page_id", F.concat(F.unhex(F.get(heads, (F.col("page_id") % 4).cast("int"))), F.col("html").cast("binary")).alias("content"))
    head = F.substring("content", 1, 4)
    kind = F.when(F.substring("content", 1, 3) == F.unhex(F.lit("ffd8ff")), "jpeg").when(head == F.unhex(F.lit("89504e47")), "png").otherwise("invalid")
    return p.select("page_id", kind.alias("kind"), F.base64(F.substring("content", 1, 12)).alias("preview"), F.octet_length("content").cast("long").alias("size"))


MAGIC = r"""WITH p AS (SELECT page_id, (CASE page_id % 4 WHEN 0 THEN '\xFF\xD8\xFF\xE0'::BLOB WHEN 1 THEN '\x89PNG'::BLOB WHEN 2 THEN 'GIF8'::BLOB ELSE ''::BLOB END) || encode(html) AS c FROM pages)
SELECT page_id, CASE WHEN hex(c)[1:6] = 'FFD8FF' THEN 'jpeg' WHEN hex(c)[1:8] = '89504E47' THEN 'png' ELSE 'invalid' END AS kind, to_base64(unhex(hex(c)[1:24])) AS preview, octet_length(c) AS size FROM p"""


def mmss_format(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.clock(F.col("o_orderkey") * 0.25).alias("shown"))


def synonym_match(spark, d):
    """Names are the same if equal or synonyms."""
    pairs = spark.sql("SELECT * FROM VALUES ('ECONOMY', 'STANDARD'), ('STANDARD', 'ECONOMY'), ('PROMO', 'LARGE'), ('LARGE', 'PROMO') AS t(x, y)")
    part = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("x"), F.when(F.col("p_size") % 2 == 0, "STANDARD").otherwise("PROMO").alias("y"))
    hit = part.join(F.broadcast(pairs.withColumn("syn", F.lit(True))), ["x", "y"], "left")
    return hit.select("p_partkey", ((F.col("x") == F.col("y")) | F.coalesce("syn", F.lit(False))).alias("same"))


SYNONYM = """SELECT p_partkey, p_type = y OR (p_type, y) IN (('ECONOMY', 'STANDARD'), ('STANDARD', 'ECONOMY'), ('PROMO', 'LARGE'), ('LARGE', 'PROMO')) AS same
FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN 'STANDARD' ELSE 'PROMO' END AS y FROM part)"""

QUERIES = {
    "text_clean": (text_clean, CLEAN),
    "word_tokenize": (word_tokenize, TOKENS),
    "word_ids": (word_ids, WORD_IDS),
    "checksum": (checksum, CHECKSUM),
    "prompt_expand": (prompt_expand, PROMPTS),
    "split_first_token": (split_first_token, SPLIT),
    "brand_prefix": (brand_prefix, BRANDS),
    "ext_mime_rules": (ext_mime_rules, MIME),
    "magic_byte_validate": (magic_byte_validate, MAGIC),
    "mmss_format": (mmss_format, "SELECT o_orderkey, printf('%02d:%02d.%d', (t // 600) % 60, (t // 10) % 60, t % 10) AS shown FROM (SELECT o_orderkey, CAST(floor(o_orderkey * 0.25::DOUBLE * 10) AS BIGINT) AS t FROM orders)"),
    "synonym_match": (synonym_match, SYNONYM),
}
