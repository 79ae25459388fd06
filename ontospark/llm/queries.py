"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, chat, decontam, fingerprint, linededup, merkle, packing, quality, ranked, sharding, simhash, telephony, warc
from .common import table, written


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages into seekable bundles, and each record as it is read back."""
    stored = written(warc.bundles(warc.with_reference(table(spark, sf_dir, "pages"), 1000)), "warc", "none")
    back = warc.read(stored, payloads=False)
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     k AS (SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN k.kept IS NULL OR k.kept = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k.kept <> p.page_id THEN k.kept END AS refers_to
FROM p LEFT JOIN k ON p.payload_digest = k.payload_digest AND p.payload_bytes >= 1000
"""


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as an event log, folded, rendered, and read back from the rendered strings."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = chat.fold(chat.as_events(rows)).withColumn("turn", F.col("message.turn"))
    parsed = chat.loss_spans(chat.parse(chat.render(messages, ["turn", "role", "text"])))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped(text: str) -> str:
    """SQL for the length-relevant escape of the chat template."""
    out = f"replace({text}, '~', '~0')"
    for k, mark in enumerate(chat.CONTROL, 1):
        mark_sql = "chr(30)" if mark == "\x1e" else f"'{mark}'"
        out = f"replace({out}, {mark_sql}, '~{k}')"
    return out


OP5_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(chat.TURN) + len(chat.SAID) + len(chat.END)} + length({_escaped('role')}) + length({_escaped('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

def vocabulary_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenized and packed into written sequences of 1024 tokens, and their pieces as read back from these."""
    return packing.pack(table(spark, sf_dir, "documents"), *vocabulary_files(), capacity=1024, end=2).drop("ids")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=3, width=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are in ten documents or more, dropped from all of them."""
    done = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), least_docs=10)
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2("row.text", 256).alias("kept_sha256"))


_KEY = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
     s AS (SELECT r, doc_id, string_split(text, chr(10)) AS parts FROM d),
     l AS (SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM s),
     k AS (SELECT r, doc_id, i, line, {_KEY} AS k FROM l),
     g AS (SELECT k FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
     m AS (SELECT k.*, g.k IS NOT NULL AS gone FROM k LEFT JOIN g USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, texts and all, dealt uniformly to shards 0 to 39, whose counts differ by one at most; sizes and checksums are of what the shards hold."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    dealt = sharding.uniform_shards(docs, 40, seed=42)
    text = F.encode(F.coalesce("row.text", F.lit("")), "utf-8")
    size = (F.octet_length(text) + 16).cast("long")
    return dealt.select("row.doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as telephony audio in a stored column; it is read back, decoded and resampled in full, and the PCM gives the features batch by batch."""
    stored = written(telephony.stored(table(spark, sf_dir, "documents"), 576), "media")
    return telephony.decoded(stored, feature=True)


def op3_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class n-gram scores of all documents; those with crc32(doc_id) mod 7 = 2 are held out."""
    held = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")) % 7 == 2
    return brown.score_documents(table(spark, sf_dir, "documents"), held)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality, toxicity, site prior and decision for every document."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with its tiled words."""
    found = decontam.flagged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    leak = found.where(F.size("leaks") > 0).select("row.doc_id", F.explode("leaks").alias("x"))
    return leak.select("doc_id", "x.item_id", "x.matched", "x.item_words", "x.coverage", F.size("x.tiles").alias("n_tiles"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as leaves of a stored tree, by language; tampered leaves, those whose doc_id's checksum 7 divides, are folded to the root that they give."""
    docs = table(spark, sf_dir, "documents")
    digest = lambda n: merkle.row_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    tampered = (F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 7 == 0) & F.col("n_chars").isNotNull()
    rows = docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("key"), F.col("doc_id").alias("id"), digest(F.col("n_chars")).alias("leaf"), F.when(tampered, digest(F.col("n_chars") + 1)).alias("changed"))
    leaves = rows.select("grp", "key", "id", F.unhex("leaf").alias("leaf"), F.unhex(F.coalesce("changed", "leaf")).alias("changed"))
    return merkle.fold(merkle.manifest(leaves)).withColumnRenamed("id", "doc_id")


def op12_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of all texts and of their edited texts, whose second half is the beginning of the next document."""
    rows, window = fingerprint.neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    text, n = F.coalesce("row.text", F.lit("")), F.length(F.coalesce("row.text", F.lit("")))
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr(text, F.lit(1), n - half), F.substr("next", F.lit(1), half))
    at = ["bucket", "ghost", "place", "hash"]
    texts = rows.select(*at, "row.doc_id", n.cast("long").alias("n_chars"), text.alias("text"), edited.alias("edited"))
    texts = fingerprint.sketched(texts, {"a": F.col("text"), "b": F.col("edited")})
    both = texts.select(*at, "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", "b").withColumn("c", F.lead("a").over(window)).where("NOT ghost")
    likeness = lambda x: fingerprint.resemblance(F.col("a"), F.col(x))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint.text_of(F.col("a")).alias("fingerprint"), fingerprint.text_of(F.col("b")).alias("edited_fingerprint"),
        likeness("b").alias("near_edited"), likeness("c").alias("near_next"),
    )


_PART = "CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"
_ROW = lambda n: " || ".join(_PART.format(x=x) for x in ("doc_id", "source", "lang", n, "text"))
_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
 lambda a, b: xor(a >> 8, list_reduce(list_prepend(xor(a, b) & 255, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))"""


def _tree(name: str, start: str) -> str:
    """Levels of binary trees: ``grp, lvl, i, h, n`` (nodes of that level)."""
    return f"""{name}(grp, lvl, i, h, n) AS ({start} UNION ALL
 SELECT grp, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY grp, lvl, i // 2, n)"""


#: The trees level by level; then each leaf's value, and its siblings, followed up to the root.
OP11_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS grp, sha256({_ROW('n_chars')}) AS leaf,
       CASE WHEN xor({_CRC}, 4294967295) % 7 = 0 THEN sha256({_ROW('n_chars + 1')}) END AS other FROM documents),
 l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM d),
 {_tree('t', 'SELECT grp, 0, i, leaf, n FROM l')},
 tm AS MATERIALIZED (SELECT * FROM t),
 s AS MATERIALIZED (SELECT grp AS g, lvl AS top, h, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n FROM tm WHERE n = 1),
 {_tree('u', "SELECT '', 0, i, h, n FROM s")},
 um AS MATERIALIZED (SELECT * FROM u),
 v AS MATERIALIZED (SELECT tm.grp, tm.lvl, tm.i, tm.h, tm.n FROM tm WHERE tm.n > 1 UNION ALL SELECT s.g, s.top + um.lvl, um.i, um.h, um.n FROM s, um),
 f(r, grp, lvl, i, h, proof) AS (
  SELECT r, grp, 0, i, coalesce(other, leaf), '' FROM l UNION ALL
  SELECT f.r, f.grp, f.lvl + 1, CASE WHEN f.lvl + 1 = s.top THEN s.i ELSE f.i // 2 END,
         sha256(CASE WHEN x.h IS NULL THEN f.h WHEN f.i % 2 = 0 THEN f.h || x.h ELSE x.h || f.h END), f.proof || coalesce(x.h, '')
  FROM f JOIN s ON f.grp = s.g AND f.lvl < s.top LEFT JOIN v AS x ON x.grp = f.grp AND x.lvl = f.lvl AND x.i = xor(f.i, 1) AND x.n > 1),
 low AS MATERIALIZED (SELECT f.r, f.grp, CASE WHEN s.top = 0 THEN s.i ELSE f.i END AS i, f.h, f.proof FROM f JOIN s ON f.grp = s.g AND f.lvl = s.top),
 w(r, lvl, i, h, proof) AS (
  SELECT r, 0, i, h, proof FROM low UNION ALL
  SELECT w.r, w.lvl + 1, w.i // 2, sha256(CASE WHEN x.h IS NULL THEN w.h WHEN w.i % 2 = 0 THEN w.h || x.h ELSE x.h || w.h END), w.proof || coalesce(x.h, '')
  FROM w JOIN um AS me ON me.lvl = w.lvl AND me.i = w.i AND me.n > 1 LEFT JOIN um AS x ON x.lvl = w.lvl AND x.i = xor(w.i, 1)),
 e AS (SELECT w.* FROM w JOIN um ON um.lvl = w.lvl AND um.i = w.i AND um.n = 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, um.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = um.h AS verified
FROM l JOIN s ON l.grp = s.g JOIN e ON e.r = l.r JOIN um ON um.n = 1
"""


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


_TERMS = r"regexp_extract_all(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH b AS (SELECT row_number() OVER () AS r, item_id, text FROM benchmark),
     q AS (SELECT r, item_id, term, count(*) AS times FROM (SELECT r, item_id, unnest({_TERMS.format(x='text')}) AS term FROM b) GROUP BY ALL),
     d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format(x='text')} AS terms FROM documents WHERE text IS NOT NULL),
     n AS (SELECT count(*) AS n, sum(len(terms)) AS total FROM d WHERE len(terms) > 0),
     t AS (SELECT r, doc_id, term, len, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS len, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
     w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, n GROUP BY term),
     s AS (SELECT q.r AS item, item_id, t.r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + CAST((75 * len * n) // total AS BIGINT))))) AS BIGINT) AS score
           FROM q JOIN t USING (term) JOIN w USING (term), n GROUP BY ALL),
     k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""


QUERIES = {
    "op1_warc": op1_warc, "op2_telephony": op2_telephony, "op3_brown": op3_brown, "op4_quality": op4_quality, "op5_chat": op5_chat,
    "op6_packing": op6_packing, "op7_simhash": op7_simhash, "op8_linededup": op8_linededup, "op9_sharding": op9_sharding, "op10_decontam": op10_decontam,
    "op11_merkle": op11_merkle, "op12_fingerprint": op12_fingerprint, "op13_ranked": op13_ranked,
}
ORACLE_SQL = {"op1_warc": OP1_SQL, "op5_chat": OP5_SQL, "op8_linededup": OP8_SQL, "op11_merkle": OP11_SQL, "op13_ranked": OP13_SQL}
