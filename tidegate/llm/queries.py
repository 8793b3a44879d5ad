"""The registered queries ``opN_<name>``: whole tables through the operators, digests derived."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import (
    bpe, exact_dedup, exact_search, line_dedup, minhash, packing, passages, pii, quality, quotes, secrets,
    vector_codes, whitening,
)
from tidegate.llm.registry import query, table


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids again; counts and digests of both."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pattern = public_tokenizers.PATTERN
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    return decoded.select(
        "doc_id", "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_secrets")
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base counts and digest, all spans."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ","
    )
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select(
        "doc_id", of_kind("assign").alias("n_assign"), of_kind("access").alias("n_access"),
        of_kind("hex").alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


OP10_SQL = r"""
with n as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as h from documents
)
select doc_id, min(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
  doc_id = min(doc_id) over (partition by h) as kept, h as text_sha256
from n
"""


@query("op10_exact_dedup", OP10_SQL)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every document."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), path, 2048)


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from the labels outside the held-out fold."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP4_SQL = r"""
with recursive words as (
  select doc_id, [x for x in string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'
  ) if x <> ''] as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [list_aggregate(w, 'string_agg', ' ')]
    else list_distinct([list_aggregate(w[i:i + 4], 'string_agg', ' ') for i in range(1, len(w) - 3)]) end as s
  from words
), shingled as (select doc_id, len(s) as n, unnest(s) as g from sets
), pairs as (
  select a.doc_id as x, b.doc_id as y from shingled a join shingled b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach as (
  select doc_id as x, doc_id as r from documents union select reach.x, pairs.y from reach join pairs on reach.r = pairs.x
), least_of as (select x, min(r) as component_id from reach group by x)
select s.doc_id, len(s.s) as n_shingles, component_id, s.doc_id = component_id as kept
from sets s join least_of l on l.x = s.doc_id
"""


@query("op4_minhash", OP4_SQL)
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


OP9_SQL = """
with v as (
  select vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as e from embeddings
  where vec_id is not null and embedding is not null and len([1 for x in embedding if x is null or not isfinite(x)]) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(coalesce(list_sum([q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)]), 0) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 10
"""


@query("op9_pivot_search", OP9_SQL)
def op9_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for every vector whose identifier is divisible by 100."""
    return exact_search.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, 10, 1024)


OP3_SQL = r"""
with lines as (
  select doc_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)
), keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines
), shared as (
  select key, min(doc_id) as keeper from keyed where length(key) >= 10 group by key having count(distinct doc_id) > 1
)
select k.doc_id, count(*) as n_lines, count(*) filter (where keeper is not null and keeper <> doc_id) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where keeper is null or keeper = doc_id), '')) as kept_sha256
from keyed k left join shared s on s.key = k.key group by k.doc_id
"""


@query("op3_line_dedup", OP3_SQL)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all documents into an empty index; what each of them keeps."""
    docs = table(spark, sf_dir, "documents")
    kept = line_dedup.LineIndex.build(docs).kept(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
with recursive said as (select conv_id, turn, min(text) as said from conversations group by conv_id, turn
), mail as (
  select c.conv_id, c.turn, c.role, concat_ws(chr(10), '> > ' || replace(b.said, chr(10), chr(10) || '> > '),
    '> ' || replace(a.said, chr(10), chr(10) || '> '), coalesce(c.text, '')) as text
  from conversations c left join said a on a.conv_id = c.conv_id and a.turn + 1 = c.turn
  left join said b on b.conv_id = c.conv_id and b.turn + 2 = c.turn
), lines as (
  select conv_id, turn, i, line, rtrim(regexp_extract(line, '^[ \t>]*'), ' ' || chr(9)) as prefix
  from (select conv_id, turn, unnest(range(1, len(l) + 1)) as i, unnest(l) as line
    from (select conv_id, turn, string_split(text, chr(10)) as l from mail))
), levels as (
  select *, length(replace(replace(prefix, ' ', ''), chr(9), '')) as d,
    case when prefix = '' then line else regexp_replace(line[length(prefix) + 1:], '^ ', '') end as b from lines
), runs as (
  select *, i - row_number() over (partition by conv_id, turn, d order by i) as run from levels
), own as (
  select m.conv_id, m.turn, m.role, trim(coalesce(string_agg(b, chr(10) order by i) filter (where d = 0), ''),
    ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as own_text
  from mail m join levels l on l.conv_id = m.conv_id and l.turn = m.turn group by m.conv_id, m.turn, m.role
), quoted as (
  select conv_id, turn, d, trim(regexp_replace(translate(string_agg(b, chr(10) order by i), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D\x1E\x1F]+', ' ', 'g'), ' ') as u
  from runs where d > 0 group by conv_id, turn, d, run
), units as (
  select conv_id, turn, trim(regexp_replace(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D\x1E\x1F]+', ' ', 'g'), ' ') as u
  from (select conv_id, turn, unnest([own_text] || string_split_regex(own_text, '\n[ \t]*\n') || string_split(own_text, chr(10))) as u from own)
), sources as (select conv_id, u, min(turn) as source_turn from units where u <> '' group by conv_id, u
), linked as (
  select q.conv_id, q.turn, q.d, case when s.source_turn < q.turn then s.source_turn end as source_turn
  from quoted q left join sources s on s.conv_id = q.conv_id and s.u = q.u where q.u <> ''
), facts as (
  select conv_id, turn, count(*) as n_passages, count(source_turn) as n_linked, max(d) as max_level,
    arg_max(source_turn, (-d, source_turn)) filter (where source_turn is not null) as parent_turn
  from linked group by conv_id, turn
), nodes as (select o.conv_id, o.turn, f.parent_turn from own o left join facts f on f.conv_id = o.conv_id and f.turn = o.turn
), up as (
  select conv_id, turn, turn as root_turn, cast(0 as bigint) as depth from nodes where parent_turn is null
  union all select n.conv_id, n.turn, u.root_turn, u.depth + 1 from nodes n join up u on u.conv_id = n.conv_id and u.turn = n.parent_turn
)
select o.conv_id, o.turn, o.role, own_text, coalesce(n_passages, 0) as n_passages, coalesce(n_linked, 0) as n_linked,
  cast(coalesce(max_level, 0) as bigint) as max_level, parent_turn, root_turn, depth,
  row_number() over (partition by o.conv_id order by root_turn, o.turn, own_text, o.role) as reply_order
from own o left join facts f on f.conv_id = o.conv_id and f.turn = o.turn
join up u on u.conv_id = o.conv_id and u.turn = o.turn
"""


@query("op6_quotation_linking", OP6_SQL)
def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as mail, linked, in reply order and without quotes."""
    return quotes.reply_order(quotes.as_mail(table(spark, sf_dir, "conversations")))


@query("op5_fuzzy_passages")
def op5_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents share, fuzzy ones included."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first four principal axes, with unit variances; null where a deviation does not fit a long."""
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"), 4, 256)
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_sql(rounds: int = 4) -> str:
    """Codebooks round by round: sums of squared differences to every entry, floors of means."""
    assigned = lambda i: f"""a{i} as (
  select id, part, arg_min(entry, (d, entry)) as entry, min(d) as d from (
    select v.id, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) as d
    from v join b{i} b on b.part = v.part and b.pos = v.pos group by v.id, v.part, b.entry
  ) group by id, part
)"""  # noqa: E731
    moved = lambda i: f"""b{i + 1} as (
  select b.part, b.entry, b.pos, coalesce(m.x, b.x) as x from b{i} b left join (
    select v.part, a.entry, v.pos, cast((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*) as bigint) as x
    from v join a{i} a on a.id = v.id and a.part = v.part group by v.part, a.entry, v.pos
  ) m on m.part = b.part and m.entry = b.entry and m.pos = b.pos
)"""  # noqa: E731
    steps = ", ".join(f"{assigned(i)}, {moved(i)}" for i in range(rounds))
    return f"""
with kept as (
  select vec_id as id, label, embedding as e from embeddings
  where embedding is not null and len([1 for x in embedding if x is null or not isfinite(x)]) = 0
), v as (
  select id, (i - 1) // (n // 4) as part, (i - 1) % (n // 4) as pos, cast(floor(1024 * cast(e[i] as double)) as bigint) as x
  from (select id, e, len(e) as n, unnest(range(1, len(e) + 1)) as i from kept)
), b0 as (
  select v.part, f.entry, v.pos, v.x from v join (
    select id, row_number() over (order by id) - 1 as entry from kept order by id limit 256
  ) f on f.id = v.id
), {steps}, {assigned(rounds)}, coded as (
  select id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' order by part) as code, cast(sum(d) as bigint) as error
  from a{rounds} group by id
)
select k.id as vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(cast(x as varchar), ',' order by part, entry, pos)) from b{rounds}) as codebooks_sha256
from kept k join coded c on c.id = k.id
"""


@query("op13_vector_codes", op13_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every embedding; null where an error does not fit a long."""
    rows = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    digits = F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    return rows.select(
        "vec_id", F.array_join(digits, "").alias("code"), F.col("error").try_cast("long").alias("error"),
        F.col("label_error").try_cast("long").alias("label_error"), "codebooks_sha256",
    )


@query("op11_personal_data")
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base counts and digest, all spans."""
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ","
    )
    return found.select(
        "doc_id", *[of_kind(kind) for kind in pii.KINDS], F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
