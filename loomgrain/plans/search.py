"""Queries of text search and vectors."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrain.functions import text as t
from loomgrain.operators import search as x
from loomgrain.operators import search_index as index
from loomgrain.operators import vectors as v
from loomgrain.sources.tables import table
from loomgrain.streaming.streams import shared_folder

TERMS = ("cache", "ledger", "rollback")
PATTERN = r"order of rows? is (not|never) [a-z]+"
LITERAL = r"cache key"


def _docs(s, d):
    return table(s, d, "documents")


def _vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", "embedding", "label")


def _queries(s, d):
    """The query set: every row whose id is divisible by 100."""
    return _vectors(s, d).filter("vec_id % 100 = 0")


def trigram_counts(s, d):
    """How many trigrams each document has, and which document has most distinct ones."""
    return _docs(s, d).filter("text is not null").select("doc_id", F.size(t.char_trigrams(F.col("text"))).alias("trigrams"))


def merged_search(s, d):
    docs = _docs(s, d)
    hits = x.regex_lines(docs, PATTERN).join(docs.select("doc_id", "source"), "doc_id")
    return x.merged_search(x.ranked_search(docs, TERMS, 100), hits, F.col("source") == "code")


def redacted(s, d):
    c = F.col("text")
    return _docs(s, d).filter("text is not null").select("doc_id", t.secret_kind(c).alias("kind"), F.md5(t.redact(c)).alias("redacted"))


def indexed_search(s, d):
    """bm25_search over an inverted index that is written to the shared folder first."""
    folder = index.build_index(_docs(s, d), {"text": F.col("text"), "path": F.col("file_path")}, shared_folder(s, "search-index"))
    return index.search_index(s, folder, TERMS, 50)


def sanitised(s, d):
    """Texts without secrets, cut to 400 bytes."""
    return _docs(s, d).filter("text is not null").select("doc_id", F.md5(t.sanitise(F.col("text"), 400)).alias("sanitised"))


def entropies(s, d):
    """Long tokens of high entropy in any text."""
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/=_-]{20,}"), F.lit(0)))
    rows = _docs(s, d).filter("text is not null").select("doc_id", F.explode(tokens).alias("token"))
    return rows.withColumn("bits", F.round(t.entropy(F.col("token")), 6)).filter(F.col("bits") >= t.SECRET_BITS)


def jaccard_heading(s, d):
    rows = _docs(s, d).filter("heading is not null and text is not null")
    return rows.select("doc_id", F.round(t.jaccard(t.plain_words(F.col("heading")), t.plain_words(F.col("text"))), 6).alias("jaccard"))


def distinct_results(s, d):
    """Per source the 20 documents that rank best, without those that resemble a better one."""
    docs = _docs(s, d)
    scores = x.bm25(docs, TERMS, F.col("text")).join(docs.select("doc_id", "source", "text"), "doc_id")
    ranked = scores.withColumn("place", F.row_number().over(W.partitionBy("source").orderBy(F.desc("score"), "doc_id"))).filter("place <= 20")
    return x.distinct_ranked(ranked.select("source", "place", "doc_id", "text"), "source", "place", "text").drop("text")


def normalized_texts(s, d):
    return _docs(s, d).filter("text is not null").select("doc_id", F.md5(t.nfc(F.col("text"))).alias("nfc"))


def text_measures(s, d):
    c = F.col("text")
    return _docs(s, d).filter("text is not null").select(
        "doc_id", t.token_estimate(c).alias("tokens_up"), t.token_estimate(c, False).alias("tokens_down"), F.md5(t.truncate_bytes(c, 1000)).alias("head"), t.looks_like_regex(F.coalesce("heading", F.lit(""))).alias("regex_like"), t.looks_like_identifier(F.coalesce("heading", F.lit(""))).alias("identifier_like")
    )


def path_kinds(s, d):
    p = F.col("file_path")
    return table(s, d, "project_files").select("id", t.path_role(p).alias("role"), t.manifest_type(p).alias("manifest"), t.urn("repo", "file", p).alias("urn"), t.urn_kind(t.urn("repo", "file", p)).alias("kind"), t.csv_field(F.col("file_path")).alias("csv"))


def reranked(s, d):
    found = v.similar_to(_vectors(s, d), [1.0] * 64, 30)
    return v.reranked(found, _vectors(s, d).filter("label <> 3").select(F.col("vec_id").alias("id"), (F.col("label") / 10).alias("score")))


QUERIES = {
    "corpus_scan": lambda s, d: x.scan_corpus(_docs(s, d)).select("doc_id", "n_bytes", "lines", F.md5("content").alias("content")),
    "trigrams": trigram_counts,
    "regex_lines": lambda s, d: x.regex_lines(_docs(s, d), PATTERN),
    "literal_lines": lambda s, d: x.regex_lines(_docs(s, d), LITERAL),
    "code_words": lambda s, d: table(s, d, "ledger_entries").filter("entity is not null").select("id", F.array_join(t.code_words(F.col("entity")), " ").alias("words")).distinct(),
    "vocabulary": lambda s, d: x.vocabulary(_docs(s, d).select("doc_id", F.col("heading").alias("text"))),
    "text_vocabulary": lambda s, d: x.vocabulary(_docs(s, d).select("doc_id", "text")),
    "bm25_search": lambda s, d: x.ranked_search(_docs(s, d), TERMS, 50),
    "fuzzy_words": lambda s, d: x.fuzzy_words(_docs(s, d), "scheduler"),
    "phrase_search": lambda s, d: x.phrase_search(_docs(s, d), "doc_id", "text", ["at", "the", "end", "of", "the", "sprint"]),
    "ledger_phrase_search": lambda s, d: x.phrase_search(table(s, d, "ledger_entries").select("id", "summary").distinct(), "id", "summary", ["alert", "rule"]),
    "merged_search": merged_search,
    "redacted": redacted,
    "indexed_search": indexed_search,
    "sanitised": sanitised,
    "high_entropy": entropies,
    "jaccard_heading": jaccard_heading,
    "distinct_results": distinct_results,
    "nfc_texts": normalized_texts,
    "text_measures": text_measures,
    "path_kinds": path_kinds,
    "window_chunks": lambda s, d: x.window_chunks(_docs(s, d)).select("doc_id", "chunk_no", "byte_offset", F.md5("chunk").alias("chunk")),
    "markdown_chunks": lambda s, d: x.markdown_chunks(_docs(s, d)),
    "nearest_vectors": lambda s, d: v.nearest(_vectors(s, d), _queries(s, d), 10),
    "vector_links": lambda s, d: v.link_counts(_vectors(s, d), 0.3),
    "similar_to": lambda s, d: v.similar_to(_vectors(s, d), [1.0] * 64, 15),
    "similar_to_all": lambda s, d: v.similar_to(_vectors(s, d), [1.0, -1.0] * 32, 0),
    "reranked": reranked,
    "best_matches": lambda s, d: v.best_matches(_vectors(s, d), _queries(s, d), 0.2, 10),
}

_WORDS = r"list_transform(regexp_extract_all(regexp_replace(regexp_replace({c}, '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '[\p{{L}}\p{{N}}]+'), lambda x: lower(x))"
_LINES = r"ln as (select doc_id, i as line_no, l[i] as line from (select doc_id, string_split(text, chr(10)) l from documents where text is not null), unnest(generate_series(1, len(l))) u(i))"


def _bm25(field: str, name: str) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{term}')) tf{i}" for i, term in enumerate(TERMS))
    df = ", ".join(f"count(*) filter (tf{i} > 0) df{i}" for i in range(len(TERMS)))
    score = " + ".join(f"case when tf{i} > 0 then ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / mean)) else 0 end" for i in range(len(TERMS)))
    return f"{name}w as (select doc_id, {_WORDS.format(c=field)} w from documents where {field} is not null), {name}c as (select doc_id, len(w) dl, {tf} from {name}w), {name}s as (select count(*) n, avg(dl) mean, {df} from {name}c), {name} as (select doc_id, {score} as score from {name}c, {name}s)"


_RANKED = f"{_bm25('text', 'b')}, {_bm25('file_path', 'p')}, ranked as (select doc_id, round(sum(score), 6) as score from (select * from b union all select * from p) where score > 0 group by 1 order by 2 desc, 1 limit @N)"
_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"
_SECRET = "case " + " ".join("when regexp_matches(text, '{}') then '{}'".format(p.replace("'", "''"), name) for name, p in t.SECRETS.items()) + " end"
_REDACT = "text"
for _name, _pattern in t.SECRETS.items():
    _REDACT = "regexp_replace({}, '{}', '[REDACTED:{}]', 'g')".format(_REDACT, _pattern.replace("'", "''"), _name)
_COS = "least(greatest(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), -1), 1)"
_E = "e as (select vec_id, embedding::double[] as em, label from embeddings)"
_NEAR = f"near as (select q.vec_id as query_id, b.vec_id as id, round({_COS.format(a='q.em', b='b.em')}, 6) as similarity from e q join e b on q.vec_id <> b.vec_id where q.vec_id % 100 = 0)"
ORACLES = {
    "corpus_scan": f"with c as (select doc_id, regexp_replace(text, '{_CONTROL}', '', 'g') as content from documents where strlen(text) <= 1000000) select doc_id, strlen(content)::int as n_bytes, case when content = '' then 0 else len(string_split(regexp_replace(content, '\\n$', ''), chr(10))) end::int as lines, md5(content) as content from c",
    "trigrams": "select doc_id, case when length(text) < 3 then 0 else len(list_distinct(list_transform(generate_series(1, length(text) - 2), lambda i: substring(text, i, 3)))) end as trigrams from documents where text is not null",
    "regex_lines": f"with {_LINES} select doc_id, line_no, trim(line, ' ') as line from ln where strlen(line) <= 1000 and regexp_matches(line, '{PATTERN}')",
    "literal_lines": f"with {_LINES} select doc_id, line_no, trim(line, ' ') as line from ln where strlen(line) <= 1000 and contains(line, '{LITERAL}')",
    "code_words": f"select distinct id, array_to_string({_WORDS.format(c='entity')}, ' ') as words from ledger_entries where entity is not null",
    "vocabulary": f"select word, count(*) as documents from (select unnest(list_distinct({_WORDS.format(c='heading')})) as word from documents where heading is not null) group by 1",
    "indexed_search": f"with {_RANKED.replace("@N", "50")} select * from ranked",
    "bm25_search": f"with {_RANKED.replace("@N", "50")} select * from ranked",
    "fuzzy_words": f"with v as (select word, count(*) as documents from (select unnest(list_distinct({_WORDS.format(c='text')})) as word from documents where text is not null) group by 1) select word, documents, damerau_levenshtein(word, 'scheduler')::int as distance from v where length(word) between 7 and 11 and damerau_levenshtein(word, 'scheduler') <= 2",
    "phrase_search": f"with w as (select doc_id, ' ' || array_to_string({_WORDS.format(c='text')}, '  ') || ' ' as s from documents where text is not null), q as (select doc_id, ((length(s) - length(replace(s, ' at  the  end  of  the  sprint ', ''))) / length(' at  the  end  of  the  sprint '))::int as times from w) select * from q where times > 0",
    "ledger_phrase_search": f"with w as (select id, ' ' || array_to_string({_WORDS.format(c='summary')}, '  ') || ' ' as s from (select distinct id, summary from ledger_entries) where summary is not null), q as (select id, ((length(s) - length(replace(s, ' alert  rule ', ''))) / length(' alert  rule '))::int as times from w) select * from q where times > 0",
    "merged_search": f"with {_RANKED.replace("@N", "100")}, {_LINES}, h as (select doc_id, max(case when source = 'code' then 15.0 else 5.0 end) extra from ln join documents using (doc_id) where strlen(line) <= 1000 and regexp_matches(line, '{PATTERN}') group by 1) select doc_id, round(coalesce(score, 0) + coalesce(extra, 0), 6) as score from ranked full join h using (doc_id) order by 2 desc, 1 limit 50",
    "redacted": f"select doc_id, {_SECRET} as kind, md5({_REDACT}) as redacted from documents where text is not null",
    "high_entropy": "with k as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{20,}'))) as token from documents where text is not null), e as (select doc_id, token, unnest(string_split(token, '')) as ch from k) select doc_id, token, round(entropy(ch), 6) as bits from e group by 1, 2 having round(entropy(ch), 6) >= 4.5",
    "jaccard_heading": r"with w as (select doc_id, list_distinct(list_filter(regexp_split_to_array(lower(heading), '[ \t\n\r]+'), lambda x: x <> '')) a, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda x: x <> '')) b from documents where heading is not null and text is not null) select doc_id, round(case when len(a) + len(b) = 0 then 1.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end, 6) as jaccard from w",
    "nfc_texts": "select doc_id, md5(nfc_normalize(text)) as nfc from documents where text is not null",
    "text_measures": "select doc_id, ceil(strlen(text) / 4)::bigint as tokens_up, (strlen(text) // 4)::bigint as tokens_down, md5(case when strlen(text) <= 1000 then text else substring(text, 1, len(list_filter(list_transform(generate_series(1, least(length(text), 1000)), lambda i: strlen(substring(text, 1, i))), lambda n: n <= 1000))) end) as head, "
    r"regexp_matches(coalesce(heading, ''), '[\\^$*+?()\[\]{}|]') as regex_like, regexp_matches(coalesce(heading, ''), '^[A-Za-z_][A-Za-z0-9_]*([.:]+[A-Za-z_][A-Za-z0-9_]*)*$') as identifier_like from documents where text is not null",
    "path_kinds": r"""with l as (select *, lower(file_path) p, regexp_matches(lower(file_path), '\.ya?ml$') y, string_split(lower(file_path), '/')[-1] n from project_files) select id, case when regexp_matches(p, '(^|/)(tests?|spec|__tests__)(/|$)') then 'test' when regexp_matches(p, '(^|/)(docs?|adr)(/|$)') then 'documentation'
 when regexp_matches(p, '(^|/)(\.github/workflows|deploy|infra|k8s|helm)(/|$)') then 'infrastructure' when regexp_matches(p, '(^|/)(config|settings|mappings)(/|$)') then 'config' when regexp_matches(p, '(^|/)(tools|scripts|bin)(/|$)') then 'tooling' when regexp_matches(p, '(^|/)(src|lib|crates|services|web|app)(/|$)') then 'source' else 'unknown' end as role,
 case when not y and regexp_matches(n, '^dockerfile(\..*)?$') then 'dockerfile' when regexp_matches(p, '\.tf(vars)?$') then 'terraform' when y and starts_with(n, 'docker-compose') then 'compose' when y and regexp_matches(p, '/(k8s|kubernetes)/') then 'kubernetes' when y and (contains(p, '/helm/') or n = 'chart.yaml') then 'helm' when y and contains(p, '.github/workflows/') then 'workflow' end as manifest,
 'urn:repo:file:' || replace(file_path, '\', '/') as urn, 'file' as kind, case when regexp_matches(file_path, '[,"\r\n]') then '"' || replace(file_path, '"', '""') || '"' else file_path end as csv from l""",
    "window_chunks": "select doc_id, (i / 1800)::int as chunk_no, strlen(substring(text, 1, i))::int as byte_offset, md5(substring(text, i + 1, 2000)) as chunk from documents, unnest(generate_series(0, greatest(length(text) - 1, 0), 1800)) u(i) where text <> ''",
    "nearest_vectors": f"with {_E}, {_NEAR} select *, row_number() over (partition by query_id order by similarity desc, id) as place from near qualify place <= 10",
    "vector_links": f"with {_E} select a.vec_id as id, count(*) filter (a.vec_id <> b.vec_id and round({_COS.format(a='a.em', b='b.em')}, 6) > 0.3) as links from e a, e b group by 1",
    "similar_to": f"with {_E}, o as (select *, list_transform(generate_series(1, 64), lambda i: 1.0::double) q from e) select vec_id as id, round({_COS.format(a='em', b='q')}, 6) as similarity from o order by 2 desc, 1 limit 15",
    "similar_to_all": f"with {_E}, o as (select *, list_transform(generate_series(1, 64), lambda i: case when i % 2 = 1 then 1.0 else -1.0 end::double) q from e) select vec_id as id, round({_COS.format(a='em', b='q')}, 6) as similarity from o",
    "reranked": f"with {_E}, o as (select *, list_transform(generate_series(1, 64), lambda i: 1.0::double) q from e), r as (select vec_id as id, label, round({_COS.format(a='em', b='q')}, 6) as similarity from o order by 3 desc, 1 limit 30), k as (select id, similarity, case when label <> 3 then label / 10 else similarity end as score from r) select *, row_number() over (order by score desc, similarity desc, id) as place from k",
    "best_matches": f"with {_E}, {_NEAR} select * from near where similarity >= 0.2 qualify row_number() over (partition by query_id order by similarity desc, id) = 1 order by similarity desc, query_id limit 10",
}
