"""Registered queries of the text operators: whole tables of a folder in, the agreed result columns out."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arenalytics.llm import (
    bpe, chat, decontamination, fingerprints, lexical, licenses, line_dedup, quality, resampling, simhash_dedup, token_counts, token_files, toxicity,
)
from arenalytics.llm.common import table
from arenalytics.session import shared_folder

ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids, and return digests of both."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(table(spark, sf_dir, "documents"), path)
    coded = coded.withColumn("ids_sha256", F.sha2("ids", 256))
    decoded = bpe.decode(coded, path)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text, and whether it exceeds a context of 4096 tokens."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the corpus as packed id files, read them back, and return each document's place and checksum."""
    path = shared_folder(spark, "token-files")
    token_files.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_files.read_ids(spark, path, each="crc32")


@query("op9_simhash_dedup")
def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; links are two differing bits or fewer."""
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    mark = F.lower(F.lpad(F.hex(F.element_at("marks", 1)), 16, "0"))
    return found.select("doc_id", mark.alias("fingerprint"), "component_id")


@query(
    "op6_decontamination",
    r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark
), b1 as (
  select item_id, w, least(len(w), 10) n, unnest(range(1, len(w) - least(len(w), 10) + 2)) i from b where len(w) > 0
), bw as materialized (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') win from b1),
d1 as materialized (select doc_id, n, unnest(range(1, len(w) - n + 2)) i, w from d, (select distinct n from bw) x where len(w) >= n),
y as materialized (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') win from d1),
hits as materialized (select distinct doc_id, item_id, i, n from y join bw using (n, win)),
pos as materialized (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hits) z group by doc_id),
its as materialized (
  select doc_id, count(*) n_items, string_agg(item, ',' order by item) ids
  from (select distinct doc_id, item_id::varchar item from hits) v group by doc_id
)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join pos on pos.doc_id = d.doc_id left join its on its.doc_id = d.doc_id
""",
)
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark window, and the items they come from."""
    found, _ = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("key").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of every document to be toxic, by a model that never sees held-out documents."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality of every document, by a model that never sees held-out documents."""
    found = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query(
    "op7_line_runs",
    """
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select doc_id, unnest(ls) line, unnest(range(len(ls))) place from d),
s as (
  select doc_id, place, line, strlen(line) - strlen(replace(line, ' ', '')) + 1 words,
    row_number() over (partition by doc_id order by place) i from l where trim(line) <> ''
), e as (select a.doc_id, a.i, b.i as last, list(m.line order by m.i) run, sum(m.words) words
  from s a join s b on b.doc_id = a.doc_id and b.i between a.i and a.i + 4 join s m on m.doc_id = a.doc_id and m.i between a.i and b.i
  group by all having count(*) >= 3 or sum(m.words) >= 50
), f as materialized (select doc_id, i, last, row_number() over (partition by run order by doc_id, i) nth from e),
r as materialized (
  select distinct s.doc_id, s.place from f join s on s.doc_id = f.doc_id and s.i between f.i and f.last where nth > 1
), k as (
  select l.doc_id, count(*) n_lines, count(r.place) n_deleted,
    coalesce(string_agg(line, chr(10) order by l.place) filter (where r.place is null), '') txt
  from l left join r on r.doc_id = l.doc_id and r.place = l.place group by l.doc_id
)
select k.doc_id, case when n_deleted > 0 then txt else text end as text, n_lines, n_deleted
from k join documents on documents.doc_id = k.doc_id
""",
)
def op7_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without any line of a maximal run that stands earlier.

    The SQL looks at runs of up to five lines, which hold every line of longer ones. This is the main query of op7, so it comes first.
    """
    found = line_dedup.deduplicated(table(spark, sf_dir, "documents"), whole_runs=True)
    return found.select("row.doc_id", "row.text", "n_lines", "n_deleted")


@query(
    "op7_line_dedup",
    """
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select doc_id, unnest(ls) line, unnest(range(len(ls))) place from d),
s as (
  select doc_id, place, line, strlen(line) - strlen(replace(line, ' ', '')) + 1 words,
    row_number() over (partition by doc_id order by place) i from l where trim(line) <> ''
), n as (
  select *, lead(line) over w l1, lead(line, 2) over w l2, lead(words) over w w1 from s window w as (partition by doc_id order by place)
), c as (
  select doc_id, i, case when words >= 50 then 1 when words + w1 >= 50 then 2 else 3 end k, line, l1, l2 from n
), f as materialized (
  select doc_id, i, k, row_number() over (
    partition by k, line, case when k > 1 then l1 end, case when k > 2 then l2 end order by doc_id, i) nth
  from c where k = 1 or (k = 2 and l1 is not null) or l2 is not null
), r as materialized (
  select distinct s.doc_id, s.place
  from (select doc_id, unnest(range(i, i + k)) i from f where nth > 1) x join s on s.doc_id = x.doc_id and s.i = x.i
), k as (
  select l.doc_id, count(*) n_lines, count(r.place) n_deleted,
    coalesce(string_agg(line, chr(10) order by l.place) filter (where r.place is null), '') txt
  from l left join r on r.doc_id = l.doc_id and r.place = l.place group by l.doc_id
)
select k.doc_id, case when n_deleted > 0 then txt else text end as text, n_lines, n_deleted
from k join documents on documents.doc_id = k.doc_id
""",
)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the shortest long enough runs of lines that stand earlier, one from each line, as the SQL says."""
    found = line_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "row.text", "n_lines", "n_deleted")


def _licence_sql() -> str:
    """The scan in SQL, with the known licences as values."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in licenses.known_rows())
    line = f"trim(regexp_replace(translate(line, {ASCII}), '{licenses.PARTS}', ' ', 'g'))"
    for old, new in licenses.EQUIVALENTS.items():
        line = f"replace({line}, {quoted(old)}, {quoted(new)})"
    return f"""
with t as (
  select 0 kind, doc_id id, coalesce(text, '') text from documents
  union all select 1, row_number() over (), text from (values {known}) v (licence, text)
), k as (select row_number() over () id, licence from (values {known}) v (licence, text)),
l as (select kind, id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) place from t),
c as (select kind, id, place, {line} line from l),
w as (
  select kind, id, count(*) n, min(line) one,
    coalesce(string_agg(line, ' ' order by place) filter (where line <> '' and not regexp_matches(line, '{licenses.COPYRIGHT}')), '') whole
  from c group by kind, id
), known as (
  select text, min(licence) licence from (
    select id, whole as text from w where kind = 1 union all select id, one from w where kind = 1 and n = 1
  ) x join k on k.id = x.id where text <> '' group by text
), notes as (
  select id, string_agg(distinct licence, ',' order by licence) notices from c join known on known.text = line where kind = 0 group by id
)
select w.id as doc_id, sha256(whole) digest, licence, coalesce(notices, '') notices
from w left join known on known.text = whole left join notes on notes.id = w.id where kind = 0
"""


@query("op4_license_scan", _licence_sql())
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences among whole texts and lines of every document."""
    found = licenses.license_scan(table(spark, sf_dir, "documents"), licenses.known_licences(spark))
    return found.select(F.col("key").alias("doc_id"), "digest", "licence", F.array_join("notices", ",").alias("notices"))


@query("op8_document_fingerprints")
def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    found = fingerprints.edited_pairs(table(spark, sf_dir, "documents"))
    own, edited, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return found.select(
        F.col("key").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(own).alias("fingerprint"), fingerprints.as_text(edited).alias("edited_fingerprint"),
        fingerprints.likeness(own, edited).alias("near_edited"), fingerprints.likeness(own, after).alias("near_next"),
    )


@query(
    "op11_lexical_search",
    r"""
with d as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from documents
), q as materialized (
  select item_id, term, count(*) qtf from (
    select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark) u group by all
), tf as materialized (select doc_id, term, count(*) tf from d group by all),
n as materialized (select doc_id, sum(tf)::bigint n from tf group by all),
c as (select count(*) as n_docs, sum(n)::bigint as n_terms from n),
w as (
  select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint w
  from tf, c where term in (select term from q) group by term
), s as (
  select item_id, tf.doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::bigint score
  from q join w using (term) join tf using (term) join n on n.doc_id = tf.doc_id, c group by all
)
select item_id, rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id)::integer rank from s where score > 0
) r where rank <= 20
""",
)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _turns_sql() -> str:
    """Flat conversations in SQL; the template is written out anew."""
    marks = r"regexp_replace({}, '([\[<])(\\*)(/?(?:INST|SYS|ANS|ROLE)\]|/?s>)', '\1\\\2\3', 'g')"
    return f"""
with c as (
  select conv_id, turn, role, coalesce(text, '') text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) loss_sha256,
  sum(length(case role when 'user' then '[INST] ' when 'system' then '[SYS] ' when 'assistant' then '[ANS] ' end || {marks.format("text")} || '</s>'))::bigint
    formatted_chars
from c group by conv_id
"""


@query("op12_chat_format", _turns_sql())
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back: digests of its turns and of what the loss sees."""
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role")
    planted = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role, said)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    found = chat.conversations(chat.from_turns(rows))
    turns, learnt = chat.read_turns(F.col("formatted")), chat.read_learnt(F.col("formatted"), F.col("mask"))
    read = found.select(F.col("tree").alias("conv_id"), turns.alias("turns"), learnt.alias("learnt"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("bigint").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars",
    )


@query("op13_importance_resampling")
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of every document towards the benchmark texts, and its rank if it is drawn."""
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
