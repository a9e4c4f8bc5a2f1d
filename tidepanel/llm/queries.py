"""The thin queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import language, licenses, mixing, quality, secrets, spelling, twins, urlfilter, vectorcodes
from tidepanel.llm.kdtree import top_k
from tidepanel.llm.near_dup import NearDup, near_duplicates
from tidepanel.llm.positional import contaminated, contamination
from tidepanel.llm.substrings import substring_dedup
from tidepanel.llm.wordpiece import read_vocabulary, token_counts

#: A public byte-pair vocabulary; words start with a space in it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Words that op8 lets stand between the terms of a window for a proximity match.
NEAR_SLOP = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best integer inner products of each vec_id divisible by 50, ties to smaller vec_id.

    Null vectors and those with null or non-finite components take no part; an id is found once, repeated rows count as one;
    other columns are ignored; no vectors, no rows.  Scores below 2^53 are exact, larger ones round.
    """
    rows = table(spark, sf_dir, "embeddings")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~F.coalesce(bad, F.lit(True)))
    rows = rows.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double")).alias("v"))
    return top_k(rows, rows.where("id % 50 = 0"), k=5)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, and each line as a notice of its own: per document its licence, and its notices."""
    found = licenses.license_scan(table(spark, sf_dir, "documents"), kinds=("text", "line"))
    notice = F.col("kind") == "line"
    return found.groupBy("doc_id").agg(
        F.max(F.when(~notice, F.col("license"))).alias("license"),
        F.sum(notice.cast("long")).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set(F.when(notice, F.col("license")))), ",").alias("notices"),
    )


def op2_license_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stretch between blank lines as a text of its own: ``doc_id, unit, license``."""
    return licenses.license_scan(table(spark, sf_dir, "documents"), kinds=("block",)).drop("kind")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document.

    Null and empty texts have none; repeated rows get a row each; a null id stays null; other columns are ignored; an empty table gives none.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit(docs))
    joined = F.concat_ws(",", F.transform("secret_spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), joined.alias("spans"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures dated over 2024 by id; list entries drawn from the hosts and their parent domains."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("day"))
    domains = captures.select(F.explode(urlfilter.parents(urlfilter.host_of(F.col("url")))).alias("domain")).where("domain <> ''").distinct()
    listed = domains.select("domain", F.md5("domain").alias("m")).where("instr(domain, '.') > 0 and ascii(m) % 3 < 2")
    entry = F.explode(F.sequence(F.lit(1), F.lit(3)))
    entries = listed.select("domain", "m", entry.alias("k")).select(
        F.when(F.ascii(F.substring("m", 2, 1)) % 2 == 0, "ads").otherwise("spam").alias("list"),
        "domain",
        F.when((F.ascii(F.substring("m", 3, 1)) + F.col("k")) % 2 == 0, "block").otherwise("allow").alias("action"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.ascii(F.expr("substring(m, 3 + k, 1)")) + 60 * F.col("k") - 60).alias("day"),
    )
    return urlfilter.url_filter(captures, entries).select("page_id", "host", "day", "n_active", "verdict", "matched")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language for every document, learned from rows that are not held out.

    Null texts and texts without letters are ``und`` with score 0, as all are if no row has a language; a null id is not held out;
    ties go to the smaller code; repeated rows get a row each; other columns are ignored; an empty table gives none.
    """
    docs = table(spark, sf_dir, "documents")
    held = language.held_out(F.col("doc_id"))
    model = language.fit(docs.where(~held).select("doc_id", "text", "lang"))
    found = language.predict(docs.select("doc_id", "text", held.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, how many of them go as repeats of a smaller doc_id, and the digest of the rest; edges as in ``substring_dedup``."""
    return substring_dedup(table(spark, sf_dir, "documents"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and shingle count of every document; edges as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"), NearDup(shingle=3, percent=85, bands=22))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document; edges as in ``contamination``."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=NEAR_SLOP)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy token counts of every document; edges as in ``token_counts``."""
    return token_counts(table(spark, sf_dir, "documents"), read_vocabulary(VOCABULARY))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document; edges as in ``mix``."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least 7 letters and 2 occurrences, each with its form and root; null and empty texts have none, repeated rows count each."""
    return spelling.group_variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, learned from trusted labels of rows that are not held out; null and empty texts are scored too."""
    found, _ = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code per usable vector; null, holed and non-finite vectors are left out, no vectors give no rows."""
    codes, books = vectorcodes.compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_top_k, op2_licenses, op2_license_blocks, op3_secrets, op4_url_filter, op5_language, op6_substring_dedup, op7_near_dup, op8_decontamination, op9_token_counts, op10_mixing, op11_spelling, op12_quality, op13_vector_codes)}


OP2 = r"""
WITH known(license, text) AS (VALUES {known}),
canon AS (SELECT license, sha256({c_text}) AS digest FROM known UNION ALL SELECT * FROM (VALUES {digests}) g(license, digest)),
parts AS (
  SELECT doc_id, 0 AS unit, text FROM documents
  UNION ALL SELECT doc_id, 1 AS unit, unnest(string_split(text, chr(10))) AS text FROM documents),
form AS (SELECT doc_id, unit, {c_text} AS c FROM parts),
found AS (SELECT doc_id, unit, license FROM form JOIN (SELECT DISTINCT license, digest FROM canon) k ON sha256(c) = k.digest WHERE c <> '')
SELECT doc_id, max(license) FILTER (unit = 0) AS license, CAST(count(*) FILTER (unit = 1) AS BIGINT) AS n_notices,
       coalesce(array_to_string(list_sort(list(DISTINCT license) FILTER (unit = 1)), ','), '') AS notices
FROM found GROUP BY doc_id
"""

OP4 = r"""
WITH cap AS (
  SELECT page_id, CAST(DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS DATE) AS day,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1)) AS host FROM pages),
par AS (SELECT DISTINCT host, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS domain
        FROM (SELECT host, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM (SELECT DISTINCT host FROM cap WHERE host <> ''))),
lst AS (SELECT DISTINCT domain, md5(domain) AS m FROM par WHERE contains(domain, '.') AND ascii(md5(domain)) % 3 < 2),
ent AS (SELECT CASE WHEN ascii(substr(m, 2, 1)) % 2 = 0 THEN 'ads' ELSE 'spam' END AS list, domain,
          CASE WHEN (ascii(substr(m, 3, 1)) + k) % 2 = 0 THEN 'block' ELSE 'allow' END AS action,
          CAST(DATE '2024-01-01' + CAST(ascii(substr(m, CAST(3 + k AS BIGINT), 1)) + 60 * k - 60 AS INTEGER) AS DATE) AS day
        FROM lst, (SELECT unnest([1, 2, 3]) AS k)),
one AS (SELECT list, domain, day, max(action) AS action FROM ent GROUP BY ALL),
iv AS (SELECT *, lead(day) OVER (PARTITION BY list, domain ORDER BY day) AS until FROM one),
hit AS (SELECT page_id, action, list || ':' || iv.domain AS matched,
          row_number() OVER (PARTITION BY page_id ORDER BY length(iv.domain) DESC, (action = 'block') DESC, action DESC, list || ':' || iv.domain DESC) AS rn,
          count(*) OVER (PARTITION BY page_id) AS n
        FROM cap JOIN par USING (host) JOIN iv ON iv.domain = par.domain AND iv.day <= cap.day AND (iv.until IS NULL OR cap.day < iv.until))
SELECT cap.page_id, cap.host, cap.day, CAST(coalesce(n, 0) AS BIGINT) AS n_active, coalesce(action, 'allow') AS verdict, coalesce(matched, '') AS matched
FROM cap LEFT JOIN hit ON hit.page_id = cap.page_id AND rn = 1
"""


def _canonical_sql(text: str) -> str:
    x = f"regexp_replace(lower({text}), '{licenses.COPYRIGHT}', '\\1', 'g')"
    x = f"trim(regexp_replace(replace({x}, '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
    for to, spellings in licenses.SPELLINGS.items():
        for other in spellings:
            x = f"replace({x}, '{other}', '{to}')"
    return x


def oracle_sql() -> dict[str, str]:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, texts in licenses.KNOWN.items() for text in texts)
    digests = ", ".join(f"('{name}', '{x}')" for name, values in licenses.DIGESTS.items() for x in values)
    found = {"op11_spelling": twins.OP11, "op13_vector_codes": twins.vector_codes()}
    return found | {"op2_licenses": OP2.replace("{known}", known).replace("{digests}", digests).replace("{c_text}", _canonical_sql("text")), "op4_url_filter": OP4, "op10_mixing": mixing.ORACLE}
