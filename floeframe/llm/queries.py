"""The registered queries of the operators in this subpackage, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, html_text, language, line_dedup, merkle, ngram_join, packing, quality, secret_scan, spelling, warc
from .common import Scratch, held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return (quality.score(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")))


@query("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs)
    return (language.predict(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"))


@query("op4_html_text")
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return (html_text.extract(pages, html_text.fit(pages)).select("page_id", "url", "text")
            .withColumn("n_chars", F.char_length("text").cast("long")))


@query("op10_secrets")
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.fit(docs)).select("doc_id", F.col("secret_spans").alias("s"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def number(kind):
        return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("s", lambda x: x["kind"] != "format")
    return found.select("doc_id", *[number(k) for k in secret_scan.KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = packing.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")
    return packing.best_fit(Scratch(spark, "packing").store(counted, "tokens"))


OP7_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, CAST(length(role) + length(text) + 33
      + (length(role) - length(replace(role, '\', ''))) + (length(text) - length(replace(text, '\', '')))
      + len(regexp_extract_all(role || chr(10) || text, '<\|(im_start|im_sep|im_end|endoftext|system|user|assistant)\|>|</?s>|\[/?INST\]|<</?SYS>>'))
    AS BIGINT) AS n
  FROM rows)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op7_chat", OP7_SQL)
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                   F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    back = chat.read_back(chat.segments(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("losses", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
                       F.char_length(trained).cast("long").alias("loss_chars"), F.sha2(trained.cast("binary"), 256).alias("loss_sha256"),
                       "formatted_chars")


OP8_SQL = r"""
WITH n AS (SELECT doc_id, coalesce(length(text), 0) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY body) AS group_size,
             first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""


@query("op8_exact_dedup", OP8_SQL)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_decontaminate")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query("op9_line_dedup")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_ngram_join")
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a string's UTF-8 bytes, bit by bit (DuckDB has no function for it)."""
    bit = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    byte = f"list_reduce(range(8), lambda c, i: {bit}, xor(crc, b))"
    data = f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce({data}, lambda crc, b: {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _told(column: str) -> str:
    return f"coalesce(octet_length(encode(CAST({column} AS VARCHAR))) || ':' || {column}, '-')"


_SIMPLY = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_LEVELS = 11          # hash steps that the SQL twin unrolls: 8**11 leaves


def _merkle_levels(name: str, source: str) -> tuple[str, str]:
    """Tables <name>0.. of (tree, pos, digest), each the hashes of runs of 8 below it; and the last of them."""
    tables = [f"{name}0 AS (SELECT tree, pos, digest, count(*) OVER (PARTITION BY tree) AS n FROM {source})"]
    for k in range(1, SQL_LEVELS + 1):
        tables.append(f"""{name}{k} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM (
            SELECT tree, pos // 8 AS pos, CASE WHEN max(n) = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest
            FROM {name}{k - 1} GROUP BY tree, pos // 8))""")
    return ", ".join(tables), f"{name}{SQL_LEVELS}"


def _merkle_folds(name: str, into: str, source: str, tree: str, pos: str) -> tuple[str, str]:
    """Tables <into>0.. with proof and folded carried up the levels of <name>; and the last of them."""
    tables = [f"{into}0 AS (SELECT * FROM {source})"]
    for k in range(SQL_LEVELS):
        run = f"(SELECT tree, pos // 8 AS run, max(n) AS n, string_agg(digest, '' ORDER BY pos) AS told FROM {name}{k} GROUP BY ALL)"
        at = f"64 * CAST({pos} // {8 ** k} % 8 AS INTEGER)"
        left, right = f"substr(told, 1, {at})", f"substr(told, {at} + 65)"
        tables.append(f"""{into}{k + 1} AS (SELECT d.* EXCLUDE (proof, folded), CASE WHEN n = 1 THEN proof ELSE proof || {left} || {right} END AS proof,
            CASE WHEN n = 1 THEN folded ELSE sha256({left} || folded || {right}) END AS folded
            FROM {into}{k} d JOIN {run} x ON x.tree = d.{tree} AND x.run = d.{pos} // {8 ** (k + 1)})""")
    return ", ".join(tables), f"{into}{SQL_LEVELS}"


def _op13_sql() -> str:
    low, low_top = _merkle_levels("low", "placed")
    high, high_top = _merkle_levels("high", "subroots")
    up, up_top = _merkle_folds("low", "up", "begun", "tree", "pos")
    over, over_top = _merkle_folds("high", "over", "halfway", "one", "tree_pos")
    fields = " || ".join(_told(c) for c in ("doc_id", "source", "lang", "n_chars"))
    return f"""
WITH leaves AS (SELECT doc_id, coalesce('s' || lang, 'n') AS tree, sha256({fields} || {_told('text')}) AS digest,
    CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN sha256({fields} || {_told(_SIMPLY)}) ELSE sha256({fields} || {_told('text')}) END AS altered
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos FROM leaves),
{low},
subroots AS (SELECT 'root' AS tree, tree AS lang, row_number() OVER (ORDER BY tree) - 1 AS pos, digest FROM {low_top}),
{high},
begun AS (SELECT doc_id, tree, pos, digest AS leaf, '' AS proof, altered AS folded FROM placed),
{up},
halfway AS (SELECT u.*, 'root' AS one, s.pos AS tree_pos, s.digest AS subroot FROM {up_top} u JOIN subroots s ON s.lang = u.tree),
{over}
SELECT doc_id, leaf, subroot, root.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root.digest AS verified
FROM {over_top}, (SELECT digest FROM {high_top}) root
"""


@query("op13_merkle", _op13_sql())
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    proved = merkle.prove_all(docs, Scratch(spark, "merkle"), F.when(tampered, F.translate("text", merkle.UPPER, merkle.LOWER)).otherwise(F.col("text")))
    return (proved.withColumn("folded_root", merkle.folded("altered", "pos", "n", "tree_pos", "n_trees", "proof"))
            .select("doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("proof")).cast("binary"), 256).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


_BASE32 = """list_aggregate(flatten(list_transform(range(8), lambda g: list_transform(range(4), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(CAST('0x' || substr(sha, 5 * g + 1, 5) AS BIGINT) // CAST(pow(32, 3 - i) AS BIGINT) % 32 AS INTEGER) + 1, 1)))),
    'string_agg', '')"""
OP12_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(encode(coalesce(html, ''))) AS sha FROM pages),
best AS (SELECT body, max(page_id) AS keep FROM p GROUP BY body)
SELECT page_id, CAST(octet_length(p.body) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM p JOIN best USING (body)
"""


@query("op12_warc", OP12_SQL)
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    scratch = Scratch(spark, "warc")
    captures = warc.write_archives(pages, f"{scratch.root}/archives", scratch, min_bytes=0)
    parts = warc.write_index(captures, f"{scratch.root}/index", scratch)
    found = warc.fetch(warc.lookup(warc.keys(pages), parts, f"{scratch.root}/index"), f"{scratch.root}/archives", payloads=False)
    return found.select(F.expr("try_cast(page_id AS BIGINT)").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers_to").cast("long").alias("refers_to"))


_RUN = "translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, {_RUN} AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS r FROM documents)),
counted AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT *, {crc32_sql("concat(doc_id, ':', run)")} AS h FROM counted),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 31 = 0
      THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, n, unnest(list_transform(range(length(word)), lambda i: {{'m': substr(word, 1, i) || '*' || substr(word, i + 2), 'd': substr(word, 1, i) || substr(word, i + 2)}})) AS x FROM words),
shorter AS (SELECT DISTINCT w.word AS a, w.n AS na, c.word AS b, c.n AS nb FROM cut c JOIN words w ON w.word = c.x.d),
pairs AS (SELECT a.word AS word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.x.m = b.x.m AND a.word <> b.word
  UNION ALL SELECT a, b, nb FROM shorter UNION ALL SELECT b, a, na FROM shorter),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form,
    CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, 0 AS depth FROM forms UNION ALL SELECT k.word, f.form, depth + 1 FROM walk k JOIN forms f ON f.word = k.root WHERE f.form IS NOT NULL)
SELECT f.word, n, n_near, form, form_n, root FROM forms f JOIN (SELECT word, arg_max(root, depth) AS root FROM walk GROUP BY word) USING (word)
"""


@query("op11_spelling", OP11_SQL)
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "spelling"))
