"""The core library's registered queries; each reads the given tables whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.words import DOLLARS_PER_MILLION, MAX_CHUNK_CHARS, MAX_EXTRA_PASSAGES, TOP_K
from folioscope.operators import chunking, evaluate, grounding, keyword, layout, nested, semantic
from folioscope.plans import oracle
from folioscope.session import cut_lineage, shared_path
from folioscope.sources import index_store, question_sets
from folioscope.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
#: Query vectors of the semantic queries: rows whose ordinal is divisible by this, against all rows.
QUERY_STEP = 50


def _once(spark: SparkSession, directory: str, name: str, *key: str) -> DataFrame:
    rows = table(spark, directory, name)
    return rows.dropDuplicates([*key])


# Nested records (problem 5).


def _nodes(spark: SparkSession, directory: str, *under: str) -> DataFrame:
    return cut_lineage(nested.record_nodes(table(spark, directory, "ask_log"), [*under] or None))


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return nested.trace_children(_nodes(spark, directory, "research", "ms", "usage"))


def p5_nodes(spark: SparkSession, directory: str) -> DataFrame:
    return nested.record_nodes(table(spark, directory, "ask_log"))


def p5_traces(spark: SparkSession, directory: str) -> DataFrame:
    return nested.trace_table(_nodes(spark, directory))


def p5_step_times(spark: SparkSession, directory: str) -> DataFrame:
    return nested.step_table(_nodes(spark, directory, "ms"))


def p5_calls(spark: SparkSession, directory: str) -> DataFrame:
    return nested.call_table(_nodes(spark, directory, "usage"))


# Chunking.


def rendered_blocks(spark: SparkSession, directory: str) -> DataFrame:
    blocks = chunking.distinct_blocks(table(spark, directory, "blocks")).where("kind = 'paragraph' and text is not null")
    line = T.render_block(F.col("text"), F.col("list_level"), F.col("continued"))
    return blocks.select("section_id", "block_ord", line.alias("line"))


def heading_trail(spark: SparkSession, directory: str) -> DataFrame:
    found = chunking.with_heading_trail(table(spark, directory, "blocks"))
    return found.select("section_id", "block_ord", "run", F.array_join("headings", " › ").alias("trail"))


def long_text_split(spark: SparkSession, directory: str) -> DataFrame:
    blocks = chunking.distinct_blocks(table(spark, directory, "blocks")).where(F.length("text") > MAX_CHUNK_CHARS)
    pieces = F.posexplode(T.split_long(F.col("text"), MAX_CHUNK_CHARS)).alias("piece_ord", "piece")
    return blocks.select("section_id", "block_ord", pieces)


def chunk_sections(spark: SparkSession, directory: str) -> DataFrame:
    chunks = chunking.chunk_sections(table(spark, directory, "blocks"), table(spark, directory, "sections"))
    pages = F.array_join(F.transform("pages", lambda p: p["page"].cast("string")), ",")
    return chunks.select("chunk_id", "section_id", "title", pages.alias("pages"), T.body_text(F.col("pages")).alias("body"))


def chunk_stats(spark: SparkSession, directory: str) -> DataFrame:
    return chunking.length_statistics(_once(spark, directory, "chunks", "chunk_id"))


def body_text(spark: SparkSession, directory: str) -> DataFrame:
    chunks = _once(spark, directory, "chunks", "chunk_id")
    search = F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), T.body_text(F.col("pages")))
    return chunks.select("chunk_id", T.body_text(F.col("pages")).alias("body"), F.sha2(search, 256).alias("search_sha256"))


# Keyword index.


def tokenize_passages(spark: SparkSession, directory: str) -> DataFrame:
    held = keyword.postings(table(spark, directory, "keyword_index")).where("field = 'body'")
    return held.select("chunk_id", "term", F.col("tf").alias("n"))


def doc_frequency(spark: SparkSession, directory: str) -> DataFrame:
    return keyword.document_frequency(keyword.postings(table(spark, directory, "keyword_index")))


def rare_words(spark: SparkSession, directory: str) -> DataFrame:
    questions = table(spark, directory, "questions")
    held = keyword.postings_of(table(spark, directory, "keyword_index"), keyword.question_terms(questions))
    return keyword.rare_words(held, questions)


def rare_word_match(spark: SparkSession, directory: str) -> DataFrame:
    return keyword.rare_word_match(table(spark, directory, "keyword_index"), table(spark, directory, "questions"))


def bm25_topk(spark: SparkSession, directory: str) -> DataFrame:
    return keyword.bm25_best(table(spark, directory, "keyword_index"), table(spark, directory, "questions"), TOP_K)


# Semantic search.


def _semantic(spark: SparkSession, directory: str, nears: tuple[int, ...] = (0,), k: int = TOP_K) -> DataFrame:
    """The search for every 50th vector, and for those that follow it by one of ``nears``."""
    vectors = table(spark, directory, "vectors")
    queries = vectors.where(F.pmod("chunk_ord", F.lit(QUERY_STEP)).isin(*nears))
    return semantic.semantic_topk(vectors, queries, k)


def semantic_topk(spark: SparkSession, directory: str) -> DataFrame:
    return _semantic(spark, directory)


def vector_products(spark: SparkSession, directory: str) -> DataFrame:
    """Squared length of every vector, summed in order in double precision."""
    vectors = semantic.usable_vectors(table(spark, directory, "vectors"))
    return vectors.select("chunk_ord", F.round(semantic.dot(F.col("embedding"), F.col("embedding")), 6).alias("squared"))


def _chunk_ids(spark: SparkSession, directory: str) -> DataFrame:
    return _once(spark, directory, "chunks", "chunk_id").select("chunk_ord", "chunk_id", "title", "section_path", "pages")


def _ranked(spark: SparkSession, directory: str, *nears: int) -> DataFrame:
    """``query, near, rank, chunk_id, similarity``."""
    ids = _chunk_ids(spark, directory).select("chunk_ord", "chunk_id")
    ranked = _semantic(spark, directory, nears or (0,)).join(ids, "chunk_ord")
    near = F.pmod("query_ord", F.lit(QUERY_STEP)).cast("int")
    return ranked.select((F.col("query_ord") - near).alias("query"), near.alias("near"), "rank", "chunk_id", "similarity")


def hybrid_search(spark: SparkSession, directory: str) -> DataFrame:
    """Vector search for every 50th chunk, with the best passage for the rare words of its title in the last slot."""
    index, ids = table(spark, directory, "keyword_index"), _chunk_ids(spark, directory)
    asked = ids.where(F.pmod("chunk_ord", F.lit(QUERY_STEP)) == 0).select(
        F.col("chunk_ord").cast("string").alias("id"), F.col("title").alias("question")
    )
    match = keyword.rare_word_match(index, asked).select(F.col("id").cast("int").alias("query"), "chunk_id")
    ranked = cut_lineage(_ranked(spark, directory))
    pairs = match.join(ranked.select("query").distinct(), "query", "left_semi").join(ids.select("chunk_ord", "chunk_id"), "chunk_id")
    known = semantic.pair_similarity(pairs.withColumnRenamed("query", "query_ord"), table(spark, directory, "vectors"))
    return semantic.with_keyword_match(ranked, known.withColumnRenamed("query_ord", "query"))


def closest_sections(spark: SparkSession, directory: str) -> DataFrame:
    return semantic.closest_sections(_ranked(spark, directory), table(spark, directory, "chunks"))


def _researched(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """The ranking of every 50th chunk, and what its three followers find in turn that it didn't find itself."""
    every = cut_lineage(_ranked(spark, directory, 0, 1, 2, 3))
    seen = every.where("near = 0").drop("near")
    hits = every.where("near > 0").withColumnRenamed("near", "search")
    return seen, semantic.round_robin(hits, seen, MAX_EXTRA_PASSAGES)


def round_robin_research(spark: SparkSession, directory: str) -> DataFrame:
    """For every 50th chunk: what its three followers find in turn that it didn't find itself."""
    return _researched(spark, directory)[1]


def _searched_twice(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    first, added = _researched(spark, directory)
    return first, added.withColumnRenamed("position", "rank")


def second_passages(spark: SparkSession, directory: str) -> DataFrame:
    """The passages of the second call: those of the first search, then the added ones."""
    return semantic.one_after_another(*_searched_twice(spark, directory), table(spark, directory, "chunks"))


def closest_after_research(spark: SparkSession, directory: str) -> DataFrame:
    """The closest sections over the added passages, then those of the first search."""
    chunks = table(spark, directory, "chunks")
    first, added = _searched_twice(spark, directory)
    return semantic.closest_sections(semantic.one_after_another(added, first, chunks), chunks)


def cited_added(spark: SparkSession, directory: str) -> DataFrame:
    """Whether an answer cites an added passage: its citation numbers are dealt to the second call's passages of one query."""
    first, added = _searched_twice(spark, directory)
    added = cut_lineage(added)
    passages = semantic.one_after_another(first, added, table(spark, directory, "chunks"))
    queries = max(1, -(-_chunk_ids(spark, directory).count() // QUERY_STEP))
    sizes = passages.groupBy("query").agg(F.max("rank").alias("size"))
    numbers = F.explode_outer(grounding.cited_numbers(F.col("parts"))).alias("number")
    each = _answers(spark, directory).select("row_id", numbers).withColumn(
        "query", (F.pmod("row_id", F.lit(queries)) * QUERY_STEP).cast("int")
    )
    dealt = each.join(sizes, "query").withColumn("rank", F.pmod(F.col("row_id") * 5 + F.col("number") - 1, F.col("size")) + 1)
    found = semantic.cites_added(dealt.join(passages, ["query", "rank"]), added).withColumn("cites_added", F.lit(True))
    return each.select("row_id").distinct().join(found, "row_id", "left").select(
        "row_id", F.coalesce("cites_added", F.lit(False)).alias("cites_added")
    )


# Index store.


def index_roundtrip(spark: SparkSession, directory: str) -> DataFrame:
    """Chunks and vectors written as an index, read back with all its checks, and joined by ordinal."""
    chunks, vectors = _chunk_ids(spark, directory), semantic.usable_vectors(table(spark, directory, "vectors"))
    both = chunks.join(vectors, "chunk_ord")
    return index_store.round_trip(both).select(
        "chunk_ord", "chunk_id", F.size("embedding").alias("dim"), F.round(semantic.dot(F.col("embedding"), F.col("embedding")), 6).alias("squared")
    )


# Grounding.


def citable_blocks(spark: SparkSession, directory: str) -> DataFrame:
    return grounding.citable_blocks(table(spark, directory, "chunks"))


def _answers(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "answer_eval").where("row_id is not null").dropDuplicates(["row_id"])


def _reply() -> Column:
    """A reply with its gaps in lines of their own, as the model writes them."""
    lines = F.transform(F.coalesce("gaps", F.array().cast("array<string>")), lambda g: F.concat(F.lit("- **GAP:** "), g))
    return F.array_join(F.concat(F.array(F.coalesce("answer", F.lit(""))), lines), "\n")


def gap_lines(spark: SparkSession, directory: str) -> DataFrame:
    replies = _answers(spark, directory).select("row_id", _reply().alias("reply"))
    return replies.select("row_id", F.posexplode(grounding.gap_lines(F.col("reply"))).alias("gap_ord", "gap"))


def dedupe_gaps(spark: SparkSession, directory: str) -> DataFrame:
    """The gaps of each answer, without those that say no more than an earlier one."""
    rows = _answers(spark, directory).where(F.size("gaps") > 0)
    return rows.select("row_id", F.posexplode(grounding.distinct_gaps(F.col("gaps"))).alias("gap_ord", "gap"))


def searchable_gaps(spark: SparkSession, directory: str) -> DataFrame:
    rows = _answers(spark, directory).where(F.size("gaps") > 0)
    return rows.select("row_id", F.posexplode(grounding.searched_gaps(F.col("gaps"))).alias("gap_ord", "gap"))


def _parts(spark: SparkSession, directory: str) -> DataFrame:
    rows = _answers(spark, directory).where(F.size("parts") > 0)
    following = lambda p, i: F.get(F.col("parts"), i + 1)
    paired = F.transform("parts", lambda p, i: F.struct(p.alias("part"), following(p, i).alias("following")))
    return rows.select("row_id", F.posexplode(paired).alias("part_ord", "pair")).select(
        "row_id", "part_ord", "pair.part.*", F.col("pair.following").alias("following")
    )


def uncited_claims(spark: SparkSession, directory: str) -> DataFrame:
    claims = grounding.is_uncited_claim(F.col("text"), F.col("citations"))
    return _parts(spark, directory).where(claims).select("row_id", "part_ord", "text")


def restatements(spark: SparkSession, directory: str) -> DataFrame:
    """Every cited part with its own text put before it uncited: where the repeated sentence starts, and what stays."""
    cited = _parts(spark, directory).where(F.size("citations") > 0)
    found = cited.withColumn("start", grounding.restated_from(F.concat("text", F.lit(" ")), F.col("text")))
    kept = F.substring("text", F.lit(1), F.col("start"))
    return found.where(F.col("start").isNotNull()).select("row_id", "part_ord", "start", kept.alias("kept"))


def passage_remarks(spark: SparkSession, directory: str) -> DataFrame:
    """Every answer with a remark about passages put before and after it, without its remarks."""
    rows = _answers(spark, directory).where("answer is not null")
    reply = F.concat(
        F.lit("The passages don't say more. They only mention it. "), F.col("answer"), F.lit("\nThese excerpts stop here.")
    )
    done = grounding.passage_remarks(reply)
    return rows.select("row_id", done["text"].alias("text"), done["dropped"].alias("dropped"))


def answer_texts(spark: SparkSession, directory: str) -> DataFrame:
    rows = _answers(spark, directory).where(F.size("parts") > 0)
    return rows.select(
        "row_id",
        grounding.answer_text(F.col("parts")).alias("text"),
        grounding.uncited_characters(F.col("parts")).alias("uncited"),
        F.array_join(F.transform(grounding.cited_numbers(F.col("parts")), lambda n: n.cast("string")), ",").alias("cited"),
    )


def gate_verdict(spark: SparkSession, directory: str) -> DataFrame:
    text = T.trim(F.coalesce("answer", F.lit("")))
    cited = F.coalesce(F.size(grounding.cited_numbers(F.col("parts"))), F.lit(0))
    gaps = F.greatest(F.coalesce(F.size("gaps"), F.lit(0)), F.lit(0))
    return _answers(spark, directory).select("row_id", grounding.verdict(text, F.greatest(cited, F.lit(0)), gaps).alias("verdict"))


def composed_gate(spark: SparkSession, directory: str) -> DataFrame:
    """Every reply through the whole gate: its parts with the citations that resolve, and its gap lines after them."""
    answers = _answers(spark, directory)
    valid = resolve_citations(spark, directory).groupBy("row_id", F.col("part").alias("part_ord")).agg(
        F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("position", "n"))), lambda x: x["n"])).alias("citations")
    )
    none = F.array().cast("array<string>")
    texts = F.when(F.size("parts") > 0, F.transform("parts", lambda p: p["text"])).otherwise(F.array("answer"))
    lines = F.transform(F.coalesce("gaps", none), lambda g: F.concat(F.lit("\n- **GAP:** "), F.coalesce(g, F.lit(""))))
    parts = answers.select("row_id", F.posexplode(F.concat(texts, F.array(F.array_join(lines, "")))).alias("part_ord", "text"))
    gated = grounding.gate(parts.join(valid, ["row_id", "part_ord"], "left"))
    return gated.withColumn("gaps", F.array_join("gaps", "\n"))


def resolve_citations(spark: SparkSession, directory: str) -> DataFrame:
    """Each citation number of an answer's parts as a quote of one to three blocks of one of five chunks.

    Some ranges leave the chunk, every seventh quote says more than its blocks, every eleventh is of another type.
    """
    chunks = table(spark, directory, "chunks")
    n = _chunk_ids(spark, directory).count()
    each = (
        _answers(spark, directory)
        .where(F.size("parts") > 0)
        .select("row_id", F.posexplode("parts").alias("part", "p"))
        .select("row_id", "part", F.posexplode("p.citations").alias("position", "number"))
        .where("number >= 1")
        .withColumn("document_index", F.col("number") - 1)
        .withColumn("chunk_ord", F.pmod(F.col("row_id") * 5 + F.col("document_index"), F.lit(max(n, 1))).cast("int"))
    )
    pointed = each.join(_chunk_ids(spark, directory).select("chunk_ord", "chunk_id"), "chunk_ord")
    documents = pointed.select(F.col("row_id").alias("query"), "document_index", "chunk_id").distinct()
    start = F.pmod(F.col("row_id") + F.col("position"), F.size("blocks") + 1).cast("int")
    length = (1 + F.pmod(F.col("row_id") + F.col("number"), F.lit(3))).cast("int")
    within = F.array_join(F.transform(F.slice("blocks", F.col("start_block") + 1, F.col("length")), lambda b: b["text"]), "  ")
    false, strange = F.pmod(F.col("row_id") + F.col("part"), F.lit(7)) == 0, F.pmod(F.col("row_id") + F.col("part"), F.lit(11)) == 0
    raw = (
        pointed.join(grounding.block_lists(chunks), "chunk_id")
        .withColumns({"start_block": start, "length": length})
        .select(
            F.col("row_id").alias("query"),
            "part",
            "position",
            F.when(strange, "page_location").otherwise("content_block_location").alias("type"),
            "document_index",
            "start_block",
            (F.col("start_block") + F.col("length")).alias("end_block"),
            F.when(false, F.concat(within, F.lit(" and more"))).otherwise(within).alias("cited_text"),
        )
    )
    return grounding.resolve_citations(raw, documents, grounding.citable_blocks(chunks)).withColumnRenamed("query", "row_id")


def citation_cards(spark: SparkSession, directory: str) -> DataFrame:
    """The pages of each valid citation as a label, and its quote as a preview."""
    found = resolve_citations(spark, directory)
    return found.select(
        "row_id", "part", "position", "n", grounding.page_label(F.split("pages", ",")).alias("label"), grounding.quote_preview(F.col("quote")).alias("preview")
    )


# Evaluation.


def evidence_chunks(spark: SparkSession, directory: str) -> DataFrame:
    read = lambda name: table(spark, directory, name)
    return evaluate.evidence_chunks(read("questions"), read("keyword_index"), read("chunks"))


def missing_expectations(spark: SparkSession, directory: str) -> DataFrame:
    return evaluate.missing_expectations(table(spark, directory, "questions"), table(spark, directory, "chunks"))


def retrieval_eval(spark: SparkSession, directory: str) -> DataFrame:
    ranked, targets = bm25_topk(spark, directory), evidence_chunks(spark, directory)
    return evaluate.retrieval_evaluation(ranked, targets, table(spark, directory, "questions"))


def retrieval_summary(spark: SparkSession, directory: str) -> DataFrame:
    rows = retrieval_eval(spark, directory)
    return rows.agg(
        F.count("*").alias("questions"),
        F.count("search_rank").alias("hits"),
        F.count_if(F.col("search_rank") <= 8).alias("hits_at_8"),
        F.round(F.coalesce(F.avg(F.coalesce(1 / F.col("search_rank"), F.lit(0.0))), F.lit(0.0)), 6).alias("mrr"),
    )


def search_eval(spark: SparkSession, directory: str) -> DataFrame:
    """The ranking alone and with the keyword safety net, per answerable question."""
    read = lambda name: table(spark, directory, name)
    index, questions = read("keyword_index"), read("questions")
    held = keyword.postings_of(index, keyword.question_terms(questions))
    ranked = cut_lineage(keyword.bm25_best(index, questions, TOP_K, held))
    matches = cut_lineage(keyword.rare_word_match(index, questions, held))
    targets = cut_lineage(evidence_chunks(spark, directory))
    return evaluate.search_evaluation(ranked, matches, targets, questions, read("chunks"))


def search_summary(spark: SparkSession, directory: str) -> DataFrame:
    return search_eval(spark, directory).agg(
        F.count("*").alias("questions"),
        F.count("ranked_rank").alias("ranked_hits"),
        F.count("search_rank").alias("search_hits"),
        F.count_if("section_hit").alias("section_hits"),
        F.count("keyword_net").alias("net_used"),
        F.count_if(F.col("keyword_net") == "added the answer").alias("net_added_answer"),
        F.count_if(F.col("ranked_rank").isNotNull() & F.col("search_rank").isNull()).alias("net_pushed_out"),
    )


def _graded(spark: SparkSession, directory: str) -> DataFrame:
    return evaluate.graded(table(spark, directory, "answer_eval"), table(spark, directory, "questions"))


def grade_answers(spark: SparkSession, directory: str) -> DataFrame:
    return _graded(spark, directory).select("row_id", "id", "outcome", "grade")


def outcome_counts(spark: SparkSession, directory: str) -> DataFrame:
    return (
        _graded(spark, directory)
        .groupBy("kind")
        .agg(
            F.count("*").alias("answers"),
            F.count_if(F.col("grade") == "pass").alias("passed"),
            F.count_if(F.col("grade") == "review").alias("for_review"),
            F.count_if(F.col("grade") == "fail").alias("failed"),
            F.count_if(F.col("grade").eqNullSafe(F.col("outcome"))).alias("as_saved"),
        )
    )


def unknown_answers(spark: SparkSession, directory: str) -> DataFrame:
    return evaluate.unknown_answers(table(spark, directory, "answer_eval"), table(spark, directory, "questions"))


def reading_checks(spark: SparkSession, directory: str) -> DataFrame:
    """Answered rows with parts, those that open with an uncited claim, and those whose uncited text names passages."""
    rows = _answers(spark, directory).where((F.col("status") == "answered") & (F.size("parts") > 0))
    filled = F.get(F.filter("parts", lambda p: T.trim(p["text"]) != ""), F.lit(0))
    sentence = F.regexp_extract(filled["text"], rf"(?s)^(.*?(?:[.!?:](?=[{T.SPACE}]|\z)|\n))", 1)
    opens = (sentence != "") & grounding.is_uncited_claim(sentence, filled["citations"])
    about = F.exists(
        "parts",
        lambda p: (F.coalesce(F.size(p["citations"]), F.lit(0)) <= 0)
        & p["text"].rlike(r"(?i)(?<![A-Za-z0-9_])(?:passages?|excerpts?)(?![A-Za-z0-9_])"),
    )
    return rows.agg(
        F.count("*").alias("answered"), F.count_if(opens).alias("opens_uncited"), F.count_if(about).alias("about_passages")
    )


def research_checks(spark: SparkSession, directory: str) -> DataFrame:
    research = nested.research_table(_nodes(spark, directory, "research"))
    return evaluate.research_checks(table(spark, directory, "answer_eval"), research)


def question_sets_roundtrip(spark: SparkSession, directory: str) -> DataFrame:
    """The questions written as JSON lines and read back."""
    path = shared_path(spark, "questions")
    question_sets.write_questions(evaluate.distinct_questions(table(spark, directory, "questions")), path)
    read = question_sets.read_questions(spark, path)
    return read.select("id", "question", F.array_join("expect", "|").alias("expect"), "out_of_scope", "answer", "evidence", "pool", "style")


def results_roundtrip(spark: SparkSession, directory: str) -> DataFrame:
    """The grades of all answers written as results and read back."""
    path = shared_path(spark, "results")
    question_sets.write_results(grade_answers(spark, directory), path)
    return spark.read.schema("row_id long, id string, outcome string, grade string").json(path)


def answer_length_medians(spark: SparkSession, directory: str) -> DataFrame:
    return evaluate.upper_median(_answers(spark, directory), "kind", F.length("answer"))


def trace_costs(spark: SparkSession, directory: str) -> DataFrame:
    """Tokens and dollars of every trace, over all of its calls."""
    calls = nested.call_table(_nodes(spark, directory, "usage"))
    dollars = F.col("tokens") * F.when(F.col("item") == "input", DOLLARS_PER_MILLION["input"]).otherwise(DOLLARS_PER_MILLION["output"]) / 1e6
    return calls.groupBy("trace_id").agg(F.sum("tokens").alias("tokens"), F.round(F.sum(dollars), 6).alias("dollars"))


# Layout.


def parsed_sections(spark: SparkSession, directory: str) -> DataFrame:
    """Sections laid out as printed lines and parsed into blocks again."""
    lines = layout.section_lines(table(spark, directory, "sections"), table(spark, directory, "blocks"))
    return layout.section_blocks(lines)


def ingest_terms(spark: SparkSession, directory: str) -> DataFrame:
    """From blocks to chunks to a keyword index: in how many of the new chunks each term occurs."""
    chunks = chunking.chunk_sections(table(spark, directory, "blocks"), table(spark, directory, "sections"))
    index = chunks.select("chunk_id", "title", T.body_text(F.col("pages")).alias("body"))
    return keyword.document_frequency(keyword.postings(index))


def section_pages(spark: SparkSession, directory: str) -> DataFrame:
    return layout.section_pages(table(spark, directory, "blocks"))


def line_texts(spark: SparkSession, directory: str) -> DataFrame:
    """Blocks laid out as positioned words, four to a line, and put together again as lines."""
    return layout.lines_from_items(layout.laid_out(table(spark, directory, "blocks"))).select(
        "doc_id", "page", "line_ord", "y", "x", "right", "size", "text"
    )


def line_geometry(spark: SparkSession, directory: str) -> DataFrame:
    return line_texts(spark, directory).drop("text")


def indent_margins(spark: SparkSession, directory: str) -> DataFrame:
    lines = layout.lines_from_items(layout.laid_out(table(spark, directory, "blocks")))
    return layout.indent_margins(lines).select("doc_id", "indent", "lines", "margin", "page_margin", "is_narrower")


_ALL = (
    p5_found, p5_nodes, p5_traces, p5_step_times, p5_calls,
    rendered_blocks, heading_trail, long_text_split, chunk_sections, chunk_stats, body_text,
    tokenize_passages, doc_frequency, rare_words, rare_word_match, bm25_topk,
    semantic_topk, vector_products, hybrid_search, closest_sections, round_robin_research, index_roundtrip,
    second_passages, closest_after_research, cited_added,
    citable_blocks, gap_lines, dedupe_gaps, searchable_gaps, uncited_claims, restatements, passage_remarks, answer_texts,
    gate_verdict, resolve_citations, citation_cards, composed_gate,
    evidence_chunks, missing_expectations, retrieval_eval, retrieval_summary, search_eval, search_summary, grade_answers, outcome_counts,
    unknown_answers, reading_checks, answer_length_medians, trace_costs,
    line_texts, line_geometry, indent_margins, section_pages, parsed_sections, ingest_terms,
    research_checks, question_sets_roundtrip, results_roundtrip,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = oracle.SQL
