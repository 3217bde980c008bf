"""Documents and chunks: text normalisation, sentences, packing, intervals, quality of pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import BLANKS

from ..functions import text as T
from ..operators import chunking as C
from ..operators import cleanup as CL
from ..operators import intervals as I
from ..operators.metrics import ratio
from .entities import WHITE_SPACE, captures, chunks, sql, texts
from .registry import Registry, table

REGISTRY = Registry()
Q = REGISTRY.query


def collapsed(x: str) -> str:
    """SQL of the collapsed text."""
    return f"trim(regexp_replace(replace({x}, chr(0), ''), '{WHITE_SPACE}', ' ', 'g'))"


def r(c, digits=6):
    return F.round(c, digits)


@Q("str01_collapse", sql("doc", body=f"select doc_id, {collapsed('text')} as clean from doc"))
def str01(spark, folder):
    return texts(spark, folder).select("doc_id", T.collapse(F.col("text")).alias("clean"))


@Q("str02_same_text", sql("cap", body=f"select request_id, lower({collapsed('raw_query')}) = lower({collapsed('normalized_query')}) as same from cap"))
def str02(spark, folder):
    return captures(spark, folder).select("request_id", T.same_text(F.col("raw_query"), F.col("normalized_query")).alias("same"))


@Q("str03_collapse_lines", sql("doc", body=f"select doc_id, array_to_string(list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: {collapsed('x')}), chr(10)) as clean from doc"))
def str03(spark, folder):
    return texts(spark, folder).select("doc_id", T.collapse_lines(F.col("text")).alias("clean"))


@Q("str06_substitutions", sql("doc", body=r"select doc_id, regexp_replace(regexp_replace(text, '(\p{L})-\n(\p{L})', '\1\2', 'g'), '[0-9]+', '#', 'g') as clean from doc"))
def str06(spark, folder):
    return texts(spark, folder).select("doc_id", T.substitute(F.col("text"), [(r"(\p{L})-\n(\p{L})", "$1$2"), ("[0-9]+", "#")]).alias("clean"))


@Q("str07_replacements", sql("doc", body="select doc_id, replace(replace(text, 'service', 'SERVICE'), 'node', 'NODE') as clean from doc"))
def str07(spark, folder):
    return texts(spark, folder).select("doc_id", T.replace_terms(F.col("text"), {"service": "SERVICE", "node": "NODE"}).alias("clean"))


@Q("str08_clean_titles")
def str08(spark, folder):
    return chunks(spark, folder).select("chunk_id", T.clean_title(F.col("section_title")).alias("title"))


@Q("str13_normalised_token", sql("cap", body=r"select request_id, regexp_replace(regexp_replace(lower(trim(raw_query)), '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', '') as token from cap"))
def str13(spark, folder):
    from ..operators.sparse import canonical_token

    return captures(spark, folder).select("request_id", canonical_token(F.trim("raw_query")).alias("token"))


@Q("str15_unique_terms", sql("cap", body="select request_id, len(list_distinct(list_filter(string_split(lower(normalized_query), ' '), lambda t: strlen(t) > 1))) as terms from cap where normalized_query is not null"))
def str15(spark, folder):
    terms = F.filter(F.split(F.lower("normalized_query"), " "), lambda t: F.octet_length(t) > 1)
    return captures(spark, folder).where("normalized_query is not null").select("request_id", F.size(F.array_distinct(terms)).cast("bigint").alias("terms"))


@Q("str16_term_coverage", sql("cap", body="select request_id, round(case when len(list_distinct(q)) > 0 then len(list_intersect(list_distinct(q), a)) / len(list_distinct(q)) else 0 end, 6) as coverage from (select request_id, string_split(lower(normalized_query), ' ') as q, string_split(lower(final_answer), ' ') as a from cap where normalized_query is not null and final_answer is not null)"))
def str16(spark, folder):
    from ..operators.rerank import coverage

    c = captures(spark, folder).where("normalized_query is not null and final_answer is not null")
    return c.select("request_id", r(coverage(F.split(F.lower("normalized_query"), " "), F.split(F.lower("final_answer"), " "))).alias("coverage"))


@Q("str19_question_key", sql("cap", body=f"select request_id, lower({collapsed('raw_query')}) as key from cap"))
def str19(spark, folder):
    return captures(spark, folder).select("request_id", T.question_key(F.col("raw_query")).alias("key"))


@Q("str20_section_path", sql("chk", body="select chunk_id, case when section_path[-1] = 'Overview' then section_path[1:-2] else section_path end as path from (select chunk_id, case when chunk_index % 3 = 0 then list_append(section_path, 'Overview') else section_path end as section_path from chk where section_path is not null)"))
def str20(spark, folder):
    c = chunks(spark, folder).where("section_path is not null")
    path = F.when(F.col("chunk_index") % 3 == 0, F.array_append("section_path", "Overview")).otherwise(F.col("section_path"))
    return c.select("chunk_id", F.when(F.try_element_at(path, F.lit(-1)) == "Overview", F.slice(path, 1, F.size(path) - 1)).otherwise(path).alias("path"))


@Q("str23_boundaries", sql("chk", body=r"select chunk_id, regexp_matches(text, '^[\p{Lu}\p{N}#]') as starts_well, regexp_matches(text, '[.!?…][\"”»)\]]*\s*$') as ends_well from chk where text is not null"))
def str23(spark, folder):
    c = chunks(spark, folder).where("text is not null")
    return c.select("chunk_id", F.col("text").rlike(r"^[\p{Lu}\p{N}#]").alias("starts_well"), F.col("text").rlike(r"[.!?…][\"”»)\]]*\s*\z").alias("ends_well"))


@Q("str25_repeated_sentences", sql("chk", body="select chunk_id, len(s) - len(list_distinct(s)) as repeated from (select chunk_id, list_filter(list_transform(string_split(text, '. '), lambda x: trim(x)), lambda x: length(x) > 0) as s from chk where text is not null)"))
def str25(spark, folder):
    s = F.filter(F.transform(F.split("text", r"\. "), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    return chunks(spark, folder).where("text is not null").select("chunk_id", T.repeated_share(s).cast("bigint").alias("repeated"))


@Q("str26_title_prefix", sql("chk", body="select chunk_id, a[1:least(len(a), len(b))] = b[1:least(len(a), len(b))] as compatible from (select chunk_id, string_split(lower(document_title), ' ') as a, string_split(lower(section_title), ' ') as b from chk where document_title is not null and section_title is not null)"))
def str26(spark, folder):
    a, b = F.split(F.lower("document_title"), " "), F.split(F.lower("section_title"), " ")
    n = F.least(F.size(a), F.size(b))
    return chunks(spark, folder).where("document_title is not null and section_title is not null").select("chunk_id", (F.slice(a, 1, n) == F.slice(b, 1, n)).alias("compatible"))


@Q("str27_page_labels", sql("doc", body=r"select doc_id, len(regexp_extract_all(text, '(?m)^\s*(?:\d+[.)]|[-*•])\s')) >= 5 as list_like, len(regexp_extract_all(text, 'https?://')) >= 3 as link_like, length(trim(text)) < 40 as tiny from doc"))
def str27(spark, folder):
    t = F.col("text")
    return texts(spark, folder).select("doc_id", (F.regexp_count(t, F.lit(r"(?m)^\s*(?:\d+[.)]|[-*•])\s")) >= 5).alias("list_like"), (F.regexp_count(t, F.lit("https?://")) >= 3).alias("link_like"), (F.length(F.trim(t)) < 40).alias("tiny"))


@Q("str28_cleanup_leaks", sql("chk", body=r"select chunk_id, len(regexp_extract_all(text, 'https?://\S+')) as urls, len(regexp_extract_all(text, '\[\d+\]')) as footnotes, regexp_matches(text, '(?i)\bpage \d+') as header from chk where text is not null"))
def str28(spark, folder):
    t = F.col("text")
    return chunks(spark, folder).where("text is not null").select("chunk_id", F.regexp_count(t, F.lit(r"https?://\S+")).cast("bigint").alias("urls"), F.regexp_count(t, F.lit(r"\[\d+\]")).cast("bigint").alias("footnotes"), t.rlike(r"(?i)\bpage \d+").alias("header"))


@Q("str29_title_overlap", sql("chk", body="select chunk_id, len(list_intersect(list_distinct(a), list_distinct(b))) >= least(2, len(list_distinct(a))) as consistent from (select chunk_id, string_split(lower(section_title), ' ') as a, string_split(lower(text), ' ') as b from chk where section_title is not null and text is not null)"))
def str29(spark, folder):
    a, b = F.array_distinct(F.split(F.lower("section_title"), " ")), F.array_distinct(F.split(F.lower("text"), " "))
    return chunks(spark, folder).where("section_title is not null and text is not null").select("chunk_id", (F.size(F.array_intersect(a, b)) >= F.least(F.lit(2), F.size(a))).alias("consistent"))


@Q("str30_list_rendering", "select l_orderkey, '[' || string_agg(printf('%.6f', l_discount), ', ' order by l_discount, l_linenumber) || ']' as rendered from lineitem group by 1")
def str30(spark, folder):
    g = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_discount")).alias("d"))
    return g.select("l_orderkey", F.concat(F.lit("["), F.array_join(F.transform("d", lambda x: F.format_string("%.6f", x)), ", "), F.lit("]")).alias("rendered"))


@Q("prj10_page_locator", sql("chk", body="select chunk_id, case when page_start = page_end then 'page:' || page_start else 'pages:' || page_start || '-' || page_end end as locator from chk"))
def prj10(spark, folder):
    return chunks(spark, folder).select("chunk_id", T.page_locator(F.col("page_start"), F.col("page_end")).alias("locator"))


@Q("prj11_prompt_block", sql("chk", body="select chunk_id, '[page ' || page_start || ']' || chr(10) || text as block from chk where text is not null"))
def prj11(spark, folder):
    return chunks(spark, folder).where("text is not null").select("chunk_id", F.concat(F.lit("[page "), F.col("page_start").cast("string"), F.lit("]\n"), "text").alias("block"))


@Q("prj13_template", sql("cap", body="select request_id, 'Question: ' || coalesce(normalized_query, '') || ' (' || coalesce(retriever_kind, '') || ')' as prompt from cap"))
def prj13(spark, folder):
    return captures(spark, folder).select("request_id", T.fill_template("Question: {{query}} ({{kind}})", {"query": F.col("normalized_query"), "kind": F.col("retriever_kind")}).alias("prompt"))


@Q("prj07_field_path", sql("chk", body="select chunk_id, ingest.embedding_model as model, ingest.embedding_model_dimension as dimension from chk"))
def prj07(spark, folder):
    return chunks(spark, folder).select("chunk_id", F.col("ingest.embedding_model").alias("model"), F.col("ingest.embedding_model_dimension").alias("dimension"))


@Q("prj08_metadata_view", sql("chk", body="select chunk_id, document_title, section_title, page_start, page_end from chk"))
def prj08(spark, folder):
    drop = ["schema_version", "doc_id", "url", "section_path", "chunk_index", "tags", "content_hash", "chunking_version", "chunk_created_at", "text", "ingest"]
    return chunks(spark, folder).drop(*drop)


@Q("prj09_inject_ingest", sql("chk", body="select chunk_id, 'm1' as model, 8 as dimension from chk"))
def prj09(spark, folder):
    c = chunks(spark, folder).withColumn("ingest", F.struct(F.lit("m1").alias("embedding_model"), F.lit(8).alias("embedding_model_dimension")))
    return c.select("chunk_id", F.col("ingest.embedding_model").alias("model"), F.col("ingest.embedding_model_dimension").alias("dimension"))


# pages and packing --------------------------------------------------------------------------------


def _pages(spark, folder):
    """Chunks as pages of their document, the page turn marks cut off."""
    c = chunks(spark, folder).where("text is not null")
    return c.select("doc_id", F.col("chunk_index").alias("page"), F.replace("text", F.lit("\f"), F.lit(" ")).alias("text"))


PAGES = f"pg as (select doc_id, chunk_index as page, {collapsed('text')} as text from chk where text is not null)"
SENT = "sent as (select doc_id, page, unnest(s) as sentence, generate_subscripts(s, 1) as pos from (select doc_id, page, list_filter(string_split(regexp_replace(text, '([.!?…][\"''”’»)\\]]*) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 0) as s from pg))"


@Q("str11_sentences", sql("chk", body=f"with {PAGES}, {SENT} select doc_id, page, count(*) as sentences, max(length(sentence)) as longest from sent group by 1, 2"))
def str11(spark, folder):
    u = C.sentence_units(_pages(spark, folder))
    return u.groupBy("doc_id", "page").agg(F.count("*").alias("sentences"), F.max(F.length("sentence")).alias("longest"))


@Q("win08_greedy_packing")
def win08(spark, folder):
    return C.fixed_chunks(C.sentence_units(_pages(spark, folder)), 350, 0.15)


@Q("doc10_fixed_chunks")
def doc10(spark, folder):
    from ..operators.upsert import content_hash

    c = C.fixed_chunks(C.sentence_units(_pages(spark, folder)), 220, 0.1)
    return c.select("doc_id", "chunk_index", T.page_locator(F.col("page_start"), F.col("page_end")).alias("locator"), content_hash(F.col("text")).alias("content_hash"), "tokens")


@Q("doc14_resplit")
def doc14(spark, folder):
    return C.resplit(chunks(spark, folder).where("text is not null"), 120, 0.2).select("doc_id", "chunk_index", "chunk_id", "part", "section_path", "page_start", "page_end", "tokens")


@Q("doc08_content_start", sql("chk", body="select doc_id, min(page_start) as first_page, max(page_end) as last_page from chk group by 1"))
def doc08(spark, folder):
    return chunks(spark, folder).groupBy("doc_id").agg(F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"))


@Q("doc09_document_stream", sql("chk", body="select doc_id, length(string_agg('<<<PAGE:' || chunk_index || '>>>' || chr(10) || text, chr(10) order by chunk_index)) as length from chk where text is not null group by 1"))
def doc09(spark, folder):
    # the pages of one document only: a document is the unit of work
    rows = chunks(spark, folder).where("text is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("p"))
    marked = F.transform("p", lambda x: F.concat(F.lit("<<<PAGE:"), x["chunk_index"].cast("string"), F.lit(">>>\n"), x["text"]))
    return rows.select("doc_id", F.length(F.array_join(marked, "\n")).alias("length"))


@Q("doc15_page_offsets", sql("chk", body="select doc_id, chunk_index, coalesce(sum(length(text) + 1) over (partition by doc_id order by chunk_index rows between unbounded preceding and 1 preceding), 0)::bigint as offset_ from chk where text is not null"))
def doc15(spark, folder):
    w = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    return chunks(spark, folder).where("text is not null").select("doc_id", "chunk_index", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("bigint").alias("offset_"))


@Q("win12_page_cursor", sql("chk", body="select doc_id, chunk_index, last_value(case when chunk_index % 3 = 0 then page_start end ignore nulls) over (partition by doc_id order by chunk_index rows between unbounded preceding and current row) as page from chk"))
def win12(spark, folder):
    c = chunks(spark, folder).select("doc_id", "chunk_index", F.when(F.col("chunk_index") % 3 == 0, F.col("page_start")).alias("page"))
    return C.page_cursor(c, "doc_id", "chunk_index", "page")


@Q("win16_neighbour_overlap", sql("chk", body=f"with {PAGES}, {SENT}, l as (select doc_id, page, list(sentence order by pos) as s from sent group by 1, 2), n as (select doc_id, page, s, lead(s) over (partition by doc_id order by page) as nxt from l) select doc_id, page, coalesce(list_max(list_filter(range(1, 9), lambda k: k <= len(s) and k <= len(nxt) and s[len(s) - k + 1:] = nxt[1:k])), 0) as shared from n where nxt is not null"))
def win16(spark, folder):
    u = C.sentence_units(_pages(spark, folder)).groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "sentence"))), lambda x: x["sentence"]).alias("s"))
    n = u.withColumn("nxt", F.lead("s").over(Window.partitionBy("doc_id").orderBy("page"))).where("nxt is not null")
    return n.select("doc_id", "page", C.shared_suffix(F.col("s"), F.col("nxt")).cast("bigint").alias("shared"))


@Q("win19_contiguous_index", sql("chk", body="select doc_id, bool_and(chunk_index = rn) as contiguous from (select doc_id, chunk_index, row_number() over (partition by doc_id order by chunk_index) - 1 as rn from chk) group by 1"))
def win19(spark, folder):
    rn = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")) - 1
    return chunks(spark, folder).select("doc_id", (F.col("chunk_index") == rn).alias("ok")).groupBy("doc_id").agg(F.bool_and("ok").alias("contiguous"))


@Q("win17_order_jumps", sql("chk", body="select chunk_id, page_start - lag(page_end) over (partition by doc_id order by chunk_index) as jump from chk"))
def win17(spark, folder):
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    return chunks(spark, folder).select("chunk_id", (F.col("page_start") - F.lag("page_end").over(w)).alias("jump"))


@Q("win18_short_between_long", sql("chk", body="select chunk_id, length(text) < 600 and lag(length(text)) over w > 900 and lead(length(text)) over w > 900 as suspicious from chk window w as (partition by doc_id order by chunk_index)"))
def win18(spark, folder):
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    n = F.length("text")
    return chunks(spark, folder).select("chunk_id", ((n < 600) & (F.lag(n).over(w) > 900) & (F.lead(n).over(w) > 900)).alias("suspicious"))


@Q("win22_span_scan", sql("chk", body="select chunk_id, case when reach is null then 'first' when page_start < reach then 'overlap' when page_start > reach + 1 then 'hole' else 'ok' end as finding from (select chunk_id, page_start, max(page_end) over (partition by doc_id order by chunk_index rows between unbounded preceding and 1 preceding) as reach from chk)"))
def win22(spark, folder):
    w = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    c = chunks(spark, folder).withColumn("reach", F.max("page_end").over(w))
    return c.select("chunk_id", F.when(F.col("reach").isNull(), "first").when(F.col("page_start") < F.col("reach"), "overlap").when(F.col("page_start") > F.col("reach") + 1, "hole").otherwise("ok").alias("finding"))


@Q("win11_prefix_tokens", sql("chk", body="select chunk_id, sum(len(string_split(text, ' '))) over (partition by doc_id order by chunk_index)::bigint as prefix from chk where text is not null"))
def win11(spark, folder):
    w = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    return chunks(spark, folder).where("text is not null").select("chunk_id", F.sum(F.size(F.split("text", " "))).over(w).alias("prefix"))


# intervals ----------------------------------------------------------------------------------------

IV = "iv as (select l_orderkey as g, l_linenumber * 10 as start_, l_linenumber * 10 + cast(l_quantity as int) as end_ from lineitem)"


def _intervals(spark, folder):
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("g"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("end"))


ISLANDS = f"{IV}, m as (select *, max(end_) over (partition by g order by start_, end_ rows between unbounded preceding and 1 preceding) as reach from iv), isl as (select *, sum(case when reach is null or start_ > reach then 1 else 0 end) over (partition by g order by start_, end_ rows unbounded preceding) as k from m), mi as (select g, min(start_) as s, max(end_) as e from isl group by g, k)"


@Q("win06_interval_merge", f"with {ISLANDS} select g, s as start, e as end from mi")
def win06(spark, folder):
    return I.merge(_intervals(spark, folder), "g")


@Q("agg30_coverage", f"with {ISLANDS.replace('start_ > reach then', 'start_ > reach + 1 then')} select g, sum(e - s + 1)::bigint as covered from mi group by 1")
def agg30(spark, folder):
    return I.coverage(_intervals(spark, folder), "g")


@Q("win07_interval_subtract", f"with {IV}, cells as (select distinct g, x from (select g, unnest(range(0, 121)) as x from (select distinct g from iv)) a where not exists (select 1 from iv where iv.g = a.g and x between start_ and end_)), isl as (select g, x, x - row_number() over (partition by g order by x) as k from cells) select g, min(x) as start, max(x) as end from isl group by g, k")
def win07(spark, folder):
    iv = _intervals(spark, folder)
    parents = iv.select("g").distinct().select("g", F.lit(0).alias("start"), F.lit(120).alias("end"))
    return I.subtract(parents, iv, "g")


@Q("jon14_point_in_interval", f"with {IV} select iv.g, o_custkey % 100 as point, start_ as start, end_ as end from iv join orders on o_orderkey = iv.g where o_custkey % 100 between start_ and end_")
def jon14(spark, folder):
    points = table(spark, folder, "orders").select(F.col("o_orderkey").alias("g"), (F.col("o_custkey") % 100).alias("point"))
    return I.containing(points, _intervals(spark, folder), "g", "point").select("g", "point", "start", "end")


@Q("jon13_interval_overlap", f"with {IV}, a as (select g, row_number() over (partition by g order by start_, end_) as id, start_, end_ from iv) select a.g, a.id as a_id, b.id as b_id from a join a b on a.g = b.g and a.id < b.id and a.start_ <= b.end_ and b.start_ <= a.end_")
def jon13(spark, folder):
    iv = _intervals(spark, folder).withColumn("id", F.row_number().over(Window.partitionBy("g").orderBy("start", "end")))
    return I.overlapping(iv, iv, "g", 16).where("a_id < b_id")


@Q("jon12_page_to_section", sql("chk", body="""with toc as (select doc_id, section_path[1] as title, 1 as level, min(page_start) as start_, max(page_end) as end_ from chk where section_path is not null group by 1, 2 union all select doc_id, section_path[2], 2, min(page_start), max(page_end) from chk where len(section_path) > 1 group by 1, 2),
 h as (select c.chunk_id, t.level, t.title, row_number() over (partition by c.chunk_id, t.level order by t.start_, t.end_, t.title) as rn from chk c join toc t on t.doc_id = c.doc_id and c.page_start between t.start_ and t.end_) select chunk_id, max(title) filter (level = 1) as part, max(title) filter (level = 2) as chapter from h where rn = 1 group by 1"""))
def jon12(spark, folder):
    c = chunks(spark, folder)
    level = lambda k: c.where(F.size("section_path") >= k).groupBy("doc_id", F.get("section_path", F.lit(k - 1)).alias("title")).agg(F.min("page_start").alias("start"), F.max("page_end").alias("end")).withColumn("level", F.lit(k))
    hits = I.containing(c.select("doc_id", "chunk_id", F.col("page_start").alias("page")), level(1).unionByName(level(2)), "doc_id", "page")
    first = Window.partitionBy("chunk_id", "level").orderBy("start", "end", "title")
    one = hits.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    pick = lambda k: F.max(F.when(F.col("level") == k, F.col("title")))
    return one.groupBy("chunk_id").agg(pick(1).alias("part"), pick(2).alias("chapter"))


@Q("set08_page_union", sql("chk", body="select doc_id, count(distinct p) as pages from (select doc_id, unnest(range(page_start, page_end + 1)) as p from chk where page_end >= page_start) group by 1"))
def set08(spark, folder):
    # pages counted by merging ranges, without a row a page
    c = chunks(spark, folder).select("doc_id", F.col("page_start").alias("start"), F.col("page_end").alias("end"))
    return I.coverage(c, "doc_id").select("doc_id", F.col("covered").alias("pages"))


@Q("set05_missing_headings", sql("chk", body="select distinct section_title as title from chk where section_title is not null except select distinct document_title from chk"))
def set05(spark, folder):
    c = chunks(spark, folder)
    return c.where("section_title is not null").select(F.col("section_title").alias("title")).subtract(c.select("document_title"))


@Q("arr01_titles_by_page", sql("chk", body="select doc_id, p as page, list_sort(list(distinct section_title)) as titles from (select doc_id, section_title, unnest(range(page_start, page_end + 1)) as p from chk where page_end >= page_start) where section_title is not null group by 1, 2"))
def arr01(spark, folder):
    c = chunks(spark, folder).where("page_end >= page_start and section_title is not null").select("doc_id", "section_title", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    return c.groupBy("doc_id", "page").agg(F.array_sort(F.collect_set("section_title")).alias("titles"))


@Q("top13_tree_sort", "select id, cast(row_number() over (order by list_transform(string_split(id, '.'), lambda x: x::int)) as int) as place from (select distinct (o_custkey % 12) || '.' || (o_orderkey % 11) as id from orders)")
def top13(spark, folder):
    from ..operators.ordering import global_row_number

    ids = table(spark, folder, "orders").select(F.concat((F.col("o_custkey") % 12).cast("string"), F.lit("."), (F.col("o_orderkey") % 11).cast("string")).alias("id")).distinct()
    return global_row_number(ids.withColumn("path", C.numeric_path(F.col("id"))), ["path"], "place").select("id", (F.col("place") + 1).cast("int").alias("place"))


@Q("doc13_section_spans")
def doc13(spark, folder):
    p = table(spark, folder, "part").select((F.col("p_partkey") % 10).alias("doc_id"), F.col("p_partkey"))
    leaf = p.select("doc_id", F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("id"), F.lit("root").alias("parent"), (F.col("p_partkey") * 10).alias("start"), (F.col("p_partkey") * 10 + 6).alias("end"))
    root = leaf.groupBy("doc_id").agg((F.min("start") - 5).alias("start"), (F.max("end") + 9).alias("end")).select("doc_id", F.lit("root").alias("id"), F.lit(None).cast("string").alias("parent"), "start", "end")
    return C.section_tree(leaf.unionByName(root))


@Q("doc06_clean_pages")
def doc06(spark, folder):
    """Documents laid out as pages of words, cleaned by the page rules."""
    word = F.transform(F.split("text", BLANKS), lambda w, i: F.struct(w.alias("text"), (F.floor(i / 10) * 12.0).alias("top"), (i % 10 * 40.0).alias("x0"), F.lit(10.0).alias("size"), (F.floor(i / 10) * 12.0 + 10.0).alias("bottom")))
    pages = texts(spark, folder).select("doc_id", F.lit(1).alias("page"), word.alias("words"), F.lit(480.0).alias("page_height"))
    return CL.clean_pages(pages, CL.PageRules(drop_lines=(("regex", r"^https?://\S+$", "any"),), substitutions=((r"\s+,", ","),)))


# quality ------------------------------------------------------------------------------------------


@Q("agg27_page_lengths", sql("doc", body="select lang, min(n) as least, max(n) as most, round(quantile_cont(n, 0.5), 4) as p50, round(quantile_cont(n, 0.9), 4) as p90, round(quantile_cont(n, 0.99), 4) as p99, round(avg((n < 200)::int), 6) as tiny, round(avg((n > 5000)::int), 6) as huge from (select lang, length(text) as n from doc) group by 1"))
def agg27(spark, folder):
    n = texts(spark, folder).select("lang", F.length("text").alias("n"))
    return n.groupBy("lang").agg(F.min("n").alias("least"), F.max("n").alias("most"), *[r(F.percentile("n", p), 4).alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.99)], r(F.avg((F.col("n") < 200).cast("int"))).alias("tiny"), r(F.avg((F.col("n") > 5000).cast("int"))).alias("huge"))


@Q("agg26_medians", "select l_shipdate::date as day, quantile_cont(l_quantity, 0.5) as median_quantity from lineitem group by 1")
def agg26(spark, folder):
    return table(spark, folder, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.percentile("l_quantity", 0.5).alias("median_quantity"))


BAG = r"""w as (select chunk_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as t from chk where text is not null), v as (select chunk_id, unnest(regexp_extract_all(lower(coalesce(section_title, '') || ' ' || text), '[\p{L}\p{N}]+')) as t from chk where text is not null),
 a as (select chunk_id, t, count(*) as n from w group by 1, 2), b as (select chunk_id, t, count(*) as m from v group by 1, 2)"""


@Q("agg28_token_recall", sql("chk", body=f"with {BAG} select chunk_id, round(sum(least(coalesce(n, 0), coalesce(m, 0))) / sum(coalesce(m, 0)), 6) as recall, round(sum(least(coalesce(n, 0), coalesce(m, 0))) / nullif(sum(coalesce(n, 0)), 0), 6) as precision_ from a full join b using (chunk_id, t) group by 1"))
def agg28(spark, folder):
    c = chunks(spark, folder).where("text is not null")
    bag = lambda t, n: c.select("chunk_id", F.explode(F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("t")).groupBy("chunk_id", "t").agg(F.count("*").alias(n))
    both = bag(F.col("text"), "n").join(bag(F.concat(F.coalesce("section_title", F.lit("")), F.lit(" "), "text"), "m"), ["chunk_id", "t"], "full")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    return both.groupBy("chunk_id").agg(r(F.sum(F.least(n, m)) / F.sum(m)).alias("recall"), r(F.sum(F.least(n, m)) / F.nullif(F.sum(n), F.lit(0))).alias("precision_"))


@Q("agg29_duplicate_pages", sql("doc", body=f"select sha1(lower({collapsed('text')})) as digest, count(*) as pages, count(*) - 1 as extra from doc group by 1 having count(*) > 1"))
def agg29(spark, folder):
    g = texts(spark, folder).groupBy(F.sha1(F.lower(T.collapse(F.col("text")))).alias("digest")).agg(F.count("*").alias("pages"))
    return g.where("pages > 1").select("digest", "pages", (F.col("pages") - 1).alias("extra"))


@Q("agg31_rule_hits", sql("doc", body=r"select 'urls' as rule, sum(len(regexp_extract_all(text, 'https?://')))::bigint as hits from doc union all select 'steps', sum(len(regexp_extract_all(text, '(?m)^\d+\. ')))::bigint from doc union all select 'fences', sum(len(string_split(text, '```')) - 1)::bigint from doc"))
def agg31(spark, folder):
    t = texts(spark, folder).agg(*[F.sum(F.regexp_count("text", F.lit(p))).alias(n) for n, p in (("urls", "https?://"), ("steps", r"(?m)^\d+\. "), ("fences", "```"))])
    return t.unpivot([], ["urls", "steps", "fences"], "rule", "hits")


@Q("agg41_sanity_counters", sql("doc", body="select source, count(*) as pages, count(*) filter (length(trim(text)) = 0) as empty, count(*) filter (length(text) < 200) as tiny, count(*) filter (length(text) > 10000) as long_ from doc group by 1"))
def agg41(spark, folder):
    n = F.length("text")
    return texts(spark, folder).groupBy("source").agg(F.count("*").alias("pages"), F.count_if(F.length(F.trim("text")) == 0).alias("empty"), F.count_if(n < 200).alias("tiny"), F.count_if(n > 10000).alias("long_"))


@Q("mth07_zero_ratio", "select l_orderkey, case when count(*) filter (l_returnflag = 'R') > 0 then round(count(*) filter (l_returnflag = 'R' and l_linestatus = 'F') / count(*) filter (l_returnflag = 'R'), 6) else 0 end as share from lineitem group by 1")
def mth07(spark, folder):
    flag = F.col("l_returnflag") == "R"
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(r(ratio(F.count_if(flag & (F.col("l_linestatus") == "F")), F.count_if(flag))).alias("share"))
