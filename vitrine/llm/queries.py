"""The registered queries of this subpackage, each with its SQL twin where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrine.llm import byte_bpe, exact_dedup, lexical_search, license_scan, line_dedup, near_dedup, packing, periodic_runs, preference, quality_rules, simhash, substring_dedup, weak_labels
from vitrine.llm.words import text_or_empty, words_of
from vitrine.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


LINES_SQL = r"""
WITH pieces AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS no FROM documents),
listed AS (SELECT doc_id, no, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS listed FROM pieces),
sets AS (SELECT doc_id, no, list_distinct(listed) AS words, list_sort(list_distinct(listed)) AS sorted FROM listed WHERE len(listed) > 0),
classes AS (SELECT sorted, min((doc_id, no)) AS spot, len(any_value(sorted)) AS n FROM sets GROUP BY sorted),
ranked AS (SELECT c.spot, w.word, c.n, row_number() OVER (PARTITION BY c.spot ORDER BY f.df, w.word) AS pos
  FROM (SELECT spot, unnest(sorted) AS word FROM classes) w JOIN classes c USING (spot)
  JOIN (SELECT word, count(*) AS df FROM (SELECT unnest(sorted) AS word FROM classes) GROUP BY word) f USING (word)),
prefixes AS (SELECT spot, word, n FROM ranked WHERE pos <= n - ceil(n * 0.8 - 1e-9) + 1),
pairs AS (SELECT DISTINCT a.spot AS one, b.spot AS two FROM prefixes a JOIN prefixes b ON a.word = b.word AND a.spot < b.spot AND least(a.n, b.n) >= greatest(a.n, b.n) * 0.8 - 1e-9),
later AS (SELECT DISTINCT two AS spot FROM pairs p JOIN classes a ON a.spot = p.one JOIN classes b ON b.spot = p.two
  WHERE len(list_intersect(a.sorted, b.sorted)) >= (a.n + b.n - len(list_intersect(a.sorted, b.sorted))) * 0.8 - 1e-9),
judged AS (SELECT s.doc_id, s.no, (s.doc_id, s.no) <> c.spot OR l.spot IS NOT NULL AS gone FROM sets s JOIN classes c USING (sorted) LEFT JOIN later l ON l.spot = c.spot)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) FILTER (WHERE gone), '') AS removed
FROM judged GROUP BY doc_id
"""


@query("op3_line_dedup", LINES_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document with a line: its lines, how many of them an earlier line of the corpus matches, and which."""
    found = line_dedup.removed_lines(documents(spark, sf_dir))
    return found.select(F.col("k").alias("doc_id"), "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"))


EXACT_SQL = r"""
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = first_value(doc_id) OVER best AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
WINDOW best AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
"""


@query("op5_exact_dedup", EXACT_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document of its group that stays."""
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def license_sql() -> str:
    """The same dictionary and rules, spelled in SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = [license_scan.plain(s) for s in license_scan.SENTENCES]
    keys, codes = ", ".join(map(quote, known)), ", ".join(quote(license_scan.code(n)) for n in range(len(known)))
    runs = [(name, "".join(license_scan.code(n) for n in run)) for name, run in license_scan.RULES]
    holds = ", ".join(f"CASE WHEN contains(a, {quote(run)}) OR contains(b, {quote(run)}) THEN {quote(name)} END" for name, run in runs)
    joined = r"regexp_replace(replace(text, chr(13), ''), '([^\n])\n([^\n])', '\1 \2', 'g')"

    def coded(text: str) -> str:
        marked = rf"regexp_replace(lower({text}), '[.!?:][ \t\r\f\x0B]', chr(10), 'g')"
        parts = rf"list_transform(string_split(regexp_replace({marked}, '[^a-z0-9\n]+', ' ', 'g'), chr(10)), lambda x: trim(x))"
        return f"list_transform(list_filter({parts}, lambda x: x <> ''), lambda x: coalesce(list_extract([{codes}], list_position([{keys}], x)), '.'))"

    return rf"""
WITH coded AS (SELECT doc_id, coalesce(array_to_string({coded("text")}, ''), '') AS a, coalesce(array_to_string({coded(joined)}, ''), '') AS b
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
found AS (SELECT doc_id, a, list_filter([{holds}], lambda x: x IS NOT NULL) AS f FROM coded)
SELECT doc_id, f[1] AS licence, coalesce((SELECT string_agg(u.name, ',' ORDER BY u.at) FROM (SELECT x.name, min(x.at) AS at FROM (SELECT unnest(f) AS name, generate_subscripts(f, 1) AS at) x GROUP BY x.name) u), '') AS licences,
  len(f) AS n_rules, length(replace(a, '.', '')) AS n_sentences FROM found
"""


@query("op9_license_scan", license_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the licences that its sentences declare."""
    return license_scan.license_scan(documents(spark, sf_dir))


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the text they decode to, as digests."""
    args = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = byte_bpe.decode(byte_bpe.encode(documents(spark, sf_dir), *args), *args)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and the place that it has in a sequence."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's figures and verdict; the labelled good, harmless documents are the trusted target."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND toxic = 0").select("doc_id")
    return quality_rules.quality_rules(documents(spark, sf_dir), trusted)


@query("op10_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies; one document of each class stays."""
    return near_dedup.near_groups(documents(spark, sf_dir))


@query("op7_substring_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, how many of them repeat an earlier passage, and a digest of the others."""
    found = substring_dedup.repeated_spans(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept_sha")).alias("kept_sha256"))


@query("op2_weak_labels")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's votes, posterior, score and verdict."""
    return weak_labels.classify(documents(spark, sf_dir))


def preference_pairs(conversations: DataFrame) -> DataFrame:
    """A pair for every conversation: it is chosen, and rejected is its twin that goes wrong at its middle assistant turn.

    From that turn on the twin repeats the conversation's first assistant text in place of each one, and it
    breaks off after the last assistant turn. A conversation without an assistant turn is
    its own twin.
    """
    mine = "conv_id"
    answers = conversations.where("role = 'assistant'").groupBy(mine).agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("answers"), F.max("turn").alias("last")
    )
    facts = answers.select(mine, "last", F.concat(F.lit("As I said: "), F.col("answers")[0]["text"]).alias("stale"), F.get("answers", F.floor(F.col("n") / 2).cast("int"))["turn"].alias("wrong"))
    chosen = conversations.select(F.col(mine).alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
    twin = conversations.join(facts, mine, "left").where("last IS NULL OR turn <= last")
    text = F.when((F.col("role") == "assistant") & (F.col("turn") >= F.col("wrong")), F.col("stale")).otherwise(F.col("text"))
    return chosen.unionByName(twin.select(F.col(mine).alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", text.alias("text")))


PREFERENCE_SQL = """
WITH answers AS (SELECT conv_id, max(turn) AS last, list({'turn': turn, 'text': text} ORDER BY turn, text) AS a, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
facts AS (SELECT conv_id, last, 'As I said: ' || a[1].text AS stale, a[n // 2 + 1].turn AS wrong FROM answers),
turns AS (SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM conversations
  UNION SELECT c.conv_id, 'rejected', turn, role, CASE WHEN role = 'assistant' AND turn >= wrong THEN stale ELSE text END
  FROM conversations c LEFT JOIN facts f USING (conv_id) WHERE last IS NULL OR turn <= last),
placed AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS place FROM turns),
ends AS (SELECT pair_id, coalesce(min(place) FILTER (WHERE n < 2 OR low <> high) - 1, max(place)) AS n_prompt_turns
  FROM (SELECT pair_id, place, count(*) AS n, min({'r': role, 't': text}) AS low, max({'r': role, 't': text}) AS high FROM placed GROUP BY pair_id, place) GROUP BY pair_id),
pieces AS (SELECT p.*, n_prompt_turns, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown, length(role) + 5 AS head FROM placed p JOIN ends USING (pair_id)),
spans AS (SELECT *, sum(length(shown)) OVER (PARTITION BY pair_id, side ORDER BY place) AS stop FROM pieces WHERE place > n_prompt_turns),
masks AS (SELECT pair_id, side, string_agg(shown, '' ORDER BY place) AS completion,
  coalesce(string_agg(CAST(stop - length(shown) + head AS BIGINT) || ',' || CAST(stop AS BIGINT), ',' ORDER BY place) FILTER (WHERE role = 'assistant'), '') AS mask FROM spans GROUP BY pair_id, side)
SELECT e.pair_id, e.n_prompt_turns, coalesce(p.prompt, '') AS prompt, coalesce(c.completion, '') AS chosen, coalesce(c.mask, '') AS chosen_mask,
  coalesce(r.completion, '') AS rejected, coalesce(r.mask, '') AS rejected_mask
FROM ends e LEFT JOIN (SELECT pair_id, string_agg(shown, '' ORDER BY place) AS prompt FROM pieces WHERE side = 'chosen' AND place <= n_prompt_turns GROUP BY pair_id) p USING (pair_id)
LEFT JOIN masks c ON c.pair_id = e.pair_id AND c.side = 'chosen' LEFT JOIN masks r ON r.pair_id = e.pair_id AND r.side = 'rejected'
"""


@query("op1_preference_format", PREFERENCE_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and its flawed twin as one prompt and two masked completions; masks as text."""
    turns = preference_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    found = preference.format_preferences(turns)
    flat = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return found.select("pair_id", "n_prompt_turns", "prompt", "chosen", flat("chosen_mask"), "rejected", flat("rejected_mask"))


@query("op11_simhash_pigeonring")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint in hex and the smallest id of its component."""
    found = simhash.simhash_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def lexical_sql() -> str:
    """Every score by the formula, for all documents that share a term with an item."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {found} AS terms FROM documents),
totals AS (SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM texts WHERE len(terms) > 0),
wanted AS (SELECT DISTINCT item_id, unnest({found}) AS term FROM benchmark),
counted AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM texts) WHERE term IN (SELECT term FROM wanted) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM counted, totals GROUP BY term),
lengths AS (SELECT r, doc_id, 100 - 90 + (90 * len(terms) * n) // l AS m FROM texts, totals WHERE len(terms) > 0),
shares AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS share FROM counted JOIN weights USING (term) JOIN lengths USING (r)),
scores AS (SELECT item_id, doc_id, CAST(sum(share) AS BIGINT) AS score FROM wanted JOIN shares USING (term) GROUP BY item_id, r, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""


@query("op12_ranked_search", lexical_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of greatest score for every benchmark item."""
    return lexical_search.ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where one document in ten repeats a stretch from some word to its end, chosen by its id's checksum."""
    h = F.crc32(F.col("doc_id").cast("string"))
    read = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g")).withColumn("words", F.when(F.col("h") % 10 == 0, words_of(text_or_empty("text"))))
    n = F.size("words")
    cut = read.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    cut = cut.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    repeated = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    planted = F.array_join(F.concat(F.slice("words", 1, F.col("a")), F.slice(repeated, 1, n - F.col("a"))), " ")
    return cut.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), planted).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs: their number, the one of greatest exponent, and digests of all runs and of the collapsed text."""
    found = periodic_runs.periodic_runs(planted_periods(documents(spark, sf_dir)))
    # Exponents are compared as fractions; the runs come by start, then period, so the first of equal ones stays.
    greater = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda kept, r: F.when(greater(r, kept), r).otherwise(kept))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
