"""Registered queries of this subpackage: each operator over its whole table, and SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplane_clusters, collocations, edit_counts, exact_dedup, line_dedup, near_dedup, packing, quality, sentence_spans, sentencepiece_codec, suffix_dedup, vector_search, warc

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Words of a repeated span at least: half of a passage of 50 words, which may begin and end inside a sentence.
SPAN_WORDS = 25


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and the digest of what they decode to."""
    return sentencepiece_codec.round_trip(_table(spark, sf_dir, "documents"), PIECES)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document's text; the largest doc_id stays."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="largest")


OP2_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of every page, written and read back."""
    return warc.archive_round_trip(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )


#: The digest in base32: five bits a letter, from five hexadecimal digits four letters.
OP3_SQL = r"""
with hashed as (
  select page_id, coalesce(url, '') as u, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as hex from pages
), coded as (
  select *, list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform(range(4), lambda k:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * g + 1, 5))::bigint >> (15 - 5 * k)) & 31)::int + 1, 1)), 'string_agg', '')), 'string_agg', '') as payload_digest,
    min(page_id) over (partition by hex, payload_bytes) as first
  from hashed
)
select page_id, payload_bytes, payload_digest, case when first < page_id then 'revisit' else 'response' end as record_type,
  case when first < page_id then first end as refers_to, case when regexp_matches(u, '[\r\n]') then replace(replace(replace(u, '%', '%25'), chr(13), '%0D'), chr(10), '%0A') else u end as url
from coded
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentence spans that an earlier one has."""
    return sentence_spans.remove_repeated_spans(_table(spark, sf_dir, "documents"), least=SPAN_WORDS)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under the model of trusted text, and whether it is kept."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("key")


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth."""
    return vector_search.nearest(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return near_dedup.near_groups(_table(spark, sf_dir, "documents")).drop("key")


OP8_SQL = r"""
with recursive texts as (
  select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as w from documents
), shingles as (
  select distinct doc_id, array_to_string(array_slice(w, i + 1, i + 5), ' ') as s
  from (select doc_id, w, unnest(range(greatest(1, len(w) - 4))) as i from texts where len(w) > 0)
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), links as (
  select x as a, y as b from (
    select p.doc_id as x, q.doc_id as y, count(*) as shared from shingles p join shingles q on p.s = q.s and p.doc_id < q.doc_id group by p.doc_id, q.doc_id
  ) join sizes n on n.doc_id = x join sizes m on m.doc_id = y where shared >= 0.8 * (n.n + m.n - shared) - 1e-9
  union all select (select min(doc_id) from texts where len(w) = 0), doc_id from texts where len(w) = 0
), ends as (
  select a, b from links union all select b, a from links
), reached as (
  select doc_id as a, doc_id as b from texts union select r.a, e.b from reached r join ends e on e.a = r.b
), classes as (
  select a as doc_id, min(b) as class_id from reached group by a
)
select doc_id, class_id, count(*) over (partition by class_id) as class_size, doc_id = class_id as kept from classes
"""


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a string of 100 bytes covers which starts earlier too."""
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP9_SQL = """
with docs as (
  select doc_id, encode(coalesce(text, '')) as body, octet_length(encode(coalesce(text, ''))) as n from documents
), windows as (
  select doc_id, pos, md5(array_slice(body, pos + 1, pos + 100)) as h from (select doc_id, body, unnest(range(n - 99)) as pos from docs where n >= 100)
), later as (
  select doc_id, pos from windows qualify row_number() over (partition by h order by doc_id, pos) > 1
), runs as (
  select doc_id, min(pos) as a, max(pos) + 100 as b from (
    select *, sum(fresh) over (partition by doc_id order by pos) as run from (
      select *, (coalesce(pos - lag(pos) over (partition by doc_id order by pos) > 100, true))::int as fresh from later))
  group by doc_id, run
), gone as (
  select doc_id, list(a order by a) as starts, list(b order by a) as stops, sum(b - a) as n_removed, count(*) as n_spans from runs group by doc_id
)
select d.doc_id, d.n::bigint as n_bytes, coalesce(g.n_removed, 0)::bigint as n_removed, coalesce(g.n_spans, 0)::bigint as n_spans,
  case when g.doc_id is null then sha256(d.body) else sha256(unhex(list_aggregate(list_transform(range(len(starts) + 1), lambda i:
    hex(array_slice(d.body, case when i = 0 then 1 else stops[i] + 1 end, case when i = len(starts) then d.n else starts[i + 1] end))), 'string_agg', ''))) end as kept_sha256
from docs d left join gone g on d.doc_id = g.doc_id
"""


def derived_edits(docs: DataFrame) -> DataFrame:
    """Edits of each document, from its own id and length: a deletion, an insertion of its source's name, a swap near the end."""
    size = F.length(F.coalesce("text", F.lit("")))
    place = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), size + 1)
    edit = lambda start, removed, inserted: F.struct(
        start.cast("long").alias("start"), F.lit(removed).cast("long").alias("removed"), inserted.alias("inserted")
    )
    return docs.withColumn(
        "edits",
        F.array(
            edit(place(1), 40, F.lit("")),
            edit(place(2), 0, F.concat(F.lit(" ("), F.col("source"), F.lit(") "))),
            edit(place(3), 7, F.col("lang")),
            edit(size, 0, F.concat(F.lit("\n\n"), F.col("lang"), F.lit(" don't"))),
        ),
    )


def op10_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after edits."""
    return edit_counts.edited_counts(derived_edits(_table(spark, sf_dir, "documents")), BYTE_BPE)


def op11_bitplane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after three rounds from 16 centroids."""
    return bitplane_clusters.clusters(_table(spark, sf_dir, "embeddings"))


def _moved(n: int) -> str:
    """SQL of a round: a{n} assigns vectors to centroids c{n}, c{n + 1} are these moved."""
    return f"""a{n} as (
  select vec_id, e, k, d from (select v.vec_id, v.e, c.k, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from v, c{n} c)
  qualify row_number() over (partition by vec_id order by d, k) = 1
), m{n} as (
  select k, pos, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as q from (select k, unnest(e) as x, unnest(range(64)) as pos from a{n}) group by k, pos
), c{n + 1} as (
  select k, coalesce(m.e, c{n}.e) as e from c{n} left join (select k, list(q::bigint order by pos) as e from m{n} group by k) m using (k)
)"""


OP11_SQL = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as (
  select row_number() over (order by sha256('1:' || vec_id)) - 1 as k, e from v order by sha256('1:' || vec_id) limit 16
), {_moved(0)}, {_moved(1)}, {_moved(2)}, a3 as (
  select vec_id, k, d from (select v.vec_id, c.k, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from v, c3 c)
  qualify row_number() over (partition by vec_id order by d, k) = 1
)
select vec_id, k::int as cluster, d::bigint as distance, (sum(d) over (partition by k))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(c3.e, ',')) as centroid_sha256
from a3 join c3 using (k)
"""


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more have."""
    return line_dedup.drop_lines(_table(spark, sf_dir, "documents"), min_docs=10, with_text=False)


OP12_SQL = r"""
with split as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as place from documents
), keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from split
), frequent as (
  select key from keyed where key <> '' group by key having count(distinct doc_id) >= 10
)
select doc_id, count(*) as n_lines, count(f.key) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by place) filter (f.key is null), '')) as kept_sha256
from keyed k left join frequent f on f.key = k.key group by doc_id
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of each language."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), cut as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), grams as (
  select lang, m, w[i + 1 : i + m] as g from (select lang, w, unnest(range(len(w))) as i from cut where len(w) > 0), (select unnest([1, 2, 3, 4]) as m) where i + m <= len(w)
), counts as (
  select lang, m, g, array_to_string(g, ' ') as phrase, count(*) as f from grams group by lang, m, g
), totals as (
  select lang, sum(f)::bigint as n from counts where m = 1 group by lang
), candidates as (
  select * from counts where m > 1 and f >= 30
), scored as (
  select c.lang, c.phrase, c.f as a, k, l.f as l, r.f as r, ((2000000::hugeint * c.f) // (l.f + r.f))::bigint as score
  from (select *, unnest(range(1, m)) as k from candidates) c
  join counts l on l.lang = c.lang and l.phrase = array_to_string(c.g[1 : k], ' ') join counts r on r.lang = c.lang and r.phrase = array_to_string(c.g[k + 1 : c.m], ' ')
  qualify row_number() over (partition by c.lang, c.phrase order by score, k) = 1
), inner_ones as (
  select lang, array_to_string(g[i + 1 : i + s], ' ') as phrase, max(f) as most
  from (select *, unnest(range(m - s + 1)) as i from (select *, unnest(range(2, m)) as s from candidates)) group by 1, 2
)
select s.lang, (row_number() over (partition by s.lang order by score desc, a desc, encode(s.phrase)))::int as rank, s.phrase, a, l, r, n, score
from scored s join totals t on t.lang = s.lang left join inner_ones h on h.lang = s.lang and h.phrase = s.phrase
where not coalesce(100 * most >= 80 * a, false) qualify rank <= 2000
"""


QUERIES = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_exact_dedup, op3_warc, op4_packing, op5_sentence_spans, op6_quality, op7_vector_search, op8_near_dedup, op9_suffix_dedup, op10_edit_counts,
              op11_bitplane_clusters, op12_line_dedup, op13_collocations)
}
ORACLES = {"op2_exact_dedup": OP2_SQL, "op3_warc": OP3_SQL, "op8_near_dedup": OP8_SQL, "op9_suffix_dedup": OP9_SQL, "op11_bitplane_clusters": OP11_SQL, "op12_line_dedup": OP12_SQL, "op13_collocations": OP13_SQL}
