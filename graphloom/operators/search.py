"""Questions about code: type, keywords, matching, ranking, call chains, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from graphloom.schema import lookup

#: Words that give a question's type, in order of precedence.
QUESTION_TYPES = (
    ("function_call", r"\b(calls?|called|invokes?|callers?|callees?)\b|调用"),
    ("inheritance", r"\b(inherits?|extends?|subclass|superclass|parent class|implements)\b|继承"),
    ("dependency", r"\b(depends?|dependency|dependencies|imports?|uses?)\b|依赖"),
    ("implementation", r"\b(how does|how is|how are|implementation|implemented|works?)\b|实现"),
    ("structure", r"\b(structure|architecture|organi[sz]ed|layers?|components?)\b|结构"),
    ("location", r"\b(where|which file|location|located|find)\b|哪里|位置"),
)
STOP_WORDS = ("the is are was were what which where when how who why does do did a an in of to for and or this that these those with from by on at it its be can will").split(" ")
TYPE_WEIGHT = {"class": 1.2, "method": 1.1, "function": 1.1, "interface": 1.0, "variable": 0.8, "field": 0.8}
TYPES_FOR = {"function_call": ["function", "method"], "inheritance": ["class", "interface"], "dependency": ["class", "module"], "implementation": ["function", "method", "class"], "structure": ["class", "module", "package"], "location": ["class", "function", "method"]}


def question_type(text: Column) -> Column:
    """The first type whose pattern occurs, else ``general``; null gives null."""
    out = F.when(text.isNull(), None)
    for name, pattern in QUESTION_TYPES:
        out = out.when(F.lower(text).rlike(pattern), name)
    return out.otherwise("general")


def keywords(text: Column) -> Column:
    """Identifiers and runs of Chinese characters in order, each once, without stop words and single letters."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z_][a-z0-9_]*|[一-鿿]+)"), 1)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)))


def _grams(x: Column) -> Column:
    """The different runs of three letters of a text, and of one and two for texts and names that are shorter."""
    n = F.length(x)
    runs = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(x, i, F.lit(k)))).otherwise(F.expr("CAST(array() AS array<string>)"))
    return F.array_distinct(F.concat(runs(1), runs(2), runs(3)))


def _lead(x: Column) -> Column:
    return F.substring(x, 1, 3)


def match_names(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that a question's keywords name: question_id, graph_id, id, keyword, score.

    questions: question_id, keywords. Equal names count 1.0, a keyword within a name 0.8, a name within a keyword 0.6,
    in any case of letters. Only different keywords and names meet, by a hash join: what is contained in another begins
    with one of its runs of three letters. Empty names and keywords match nothing.
    """
    k = questions.select("question_id", F.explode("keywords").alias("keyword")).where("length(keyword) > 0")
    n = nodes.select("graph_id", "id", F.lower("name").alias("lname")).where("length(lname) > 0")
    words, names = k.select("keyword").distinct(), n.select("lname").distinct()
    inside = words.withColumn("_g", _lead(F.col("keyword"))).join(names.withColumn("_g", F.explode(_grams(F.col("lname")))), "_g").where(F.col("lname").contains(F.col("keyword")))
    around = words.withColumn("_g", F.explode(_grams(F.col("keyword")))).join(names.withColumn("_g", _lead(F.col("lname"))), "_g").where(F.col("keyword").contains(F.col("lname")))
    pairs = inside.select("keyword", "lname", F.when(F.col("keyword") == F.col("lname"), 1.0).otherwise(0.8).alias("score")).unionByName(around.select("keyword", "lname", F.lit(0.6).alias("score")))
    best = pairs.groupBy("keyword", "lname").agg(F.max("score").alias("score"))
    return k.join(best, "keyword").join(n, "lname").select("question_id", "graph_id", "id", "keyword", "score")


def locate(questions: DataFrame, nodes: DataFrame, k: int = 20) -> DataFrame:
    """The k best nodes of each question (question_id, text) by names and by the types that its kind asks for:
    question_id, graph_id, id, type, name, hits, score, rank. A node found both ways counts with both.

    By type the first ten nodes of each kind of question are added, at a score of 0.3, as names alone may name none.
    """
    q = questions.select("question_id", question_type(F.col("text")).alias("kind"), keywords(F.col("text")).alias("keywords"))
    found = match_names(q, nodes)
    typed = None
    for kind in TYPES_FOR:
        some = by_question_type(nodes, kind).select(F.lit(kind).alias("kind"), "graph_id", "id")
        typed = some if typed is None else typed.unionByName(some)
    fit = q.select("question_id", "kind").join(typed, "kind").select("question_id", "graph_id", "id", F.lit("").alias("keyword"), F.lit(0.3).alias("score"))
    return rank_matches(found.unionByName(fit), nodes, k)


def rank_matches(matches: DataFrame, nodes: DataFrame, k: int = 20) -> DataFrame:
    """The k best nodes per question: summed scores times the weight of the type."""




    s = matches.groupBy("question_id", "graph_id", "id").agg(F.sum("score").alias("s"), F.countDistinct("keyword").alias("hits"))
    s = s.join(nodes.select("graph_id", "id", "type", "name", "file_path"), ["graph_id", "id"])
    s = s.withColumn("score", F.round(F.col("s") * lookup(TYPE_WEIGHT, F.col("type"), 1.0), 6))
    w = W.partitionBy("question_id").orderBy(F.desc("score"), "graph_id", "id")
    # row_number under a limit is cut before the shuffle, so a question's matches don't meet in one task
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("question_id", "graph_id", "id", "type", "name", "hits", "score", "rank")


def by_question_type(nodes: DataFrame, kind: str, k: int = 10) -> DataFrame:
    """The first k nodes of the types that fit a question's type."""
    return nodes.where(F.col("type").isin(TYPES_FOR.get(kind, []))).orderBy("graph_id", "id").limit(k).select("graph_id", "id", "type", "name")


def calls(edges: DataFrame, k: int = 10) -> DataFrame:
    """The first k distinct callers of each node: graph_id, id, callers (sorted), all (their number).

    Distinct pairs are made first, so a hub's edges are spread; its list holds k ids at most.
    """


    e = edges.where(F.lower("type").isin("calls", "uses", "depends")).select("graph_id", F.col("target_id").alias("id"), F.col("source_id").alias("caller")).distinct()
    n = e.groupBy("graph_id", "id").agg(F.count("*").alias("all"))
    top = e.withColumn("r", F.row_number().over(W.partitionBy("graph_id", "id").orderBy("caller"))).where(F.col("r") <= k)
    return top.groupBy("graph_id", "id").agg(F.array_join(F.array_sort(F.collect_list("caller")), ",").alias("callers")).join(n, ["graph_id", "id"])


def call_chains(edges: DataFrame, ids: DataFrame, k: int = 10) -> DataFrame:
    """For each of a few nodes (graph_id, id) its first callers and callees as ``a,b,x`` and ``x,c,d``."""
    e = edges.where(F.lower("type").isin("calls", "uses", "depends"))
    back = e.select("graph_id", "type", F.col("source_id").alias("target_id"), F.col("target_id").alias("source_id"))
    up = calls(e.join(ids.withColumnRenamed("id", "target_id"), ["graph_id", "target_id"], "left_semi"), k).select("graph_id", "id", F.col("callers").alias("up"))
    down = calls(back.join(ids.withColumnRenamed("id", "target_id"), ["graph_id", "target_id"], "left_semi"), k).select("graph_id", "id", F.col("callers").alias("down"))
    x = ids.join(up, ["graph_id", "id"], "left").join(down, ["graph_id", "id"], "left")
    return x.select("graph_id", "id", F.concat_ws(",", "up", "id").alias("callers"), F.concat_ws(",", "id", "down").alias("callees"))


def answer_context(questions: DataFrame, nodes: DataFrame, k: int = 20) -> DataFrame:
    """Questions (question_id, text) with type, the k best nodes and the confidence: what a language model is asked with."""
    q = questions.select("question_id", question_type(F.col("text")).alias("question_type"), keywords(F.col("text")).alias("keywords"))
    m = match_names(q, nodes)
    best = rank_matches(m, nodes, k).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "graph_id", "id", "name", "score"))).alias("nodes"))
    seen = m.groupBy("question_id").agg(F.count("*").alias("_h"), F.countDistinct("keyword").alias("_w"), F.countDistinct("graph_id", "id").alias("_e"))
    out = q.join(best, "question_id", "left").join(seen, "question_id", "left")
    return out.select("question_id", "question_type", "keywords", "nodes", F.coalesce(confidence(F.col("_h"), F.col("_w"), F.col("_e")), F.lit(0.0)).alias("confidence"))


def confidence(hits: Column, words: Column, elements: Column) -> Column:
    """Hits by keywords and elements, raised for three elements and more, at most 1."""
    raw = hits / (words * elements) * F.when(elements >= 3, 1.2).otherwise(1.0)
    return F.when((words > 0) & (elements > 0), F.least(F.lit(1.0), raw)).otherwise(0.0)


def context_statistics(nodes: DataFrame) -> DataFrame:
    """Per graph and type: nodes, files, least, greatest and mean complexity."""
    return nodes.groupBy("graph_id", "type").agg(F.count("*").alias("nodes"), F.countDistinct("file_path").alias("files"), F.min("complexity").alias("least"), F.max("complexity").alias("most"), F.round(F.avg("complexity"), 6).alias("mean"))


def cosine_top(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """The k vectors of greatest cosine with a query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with("embedding", q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    size = sum(x * x for x in query) ** 0.5
    return vectors.select("vec_id", F.round(dot / (norm * size), 6).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(k)
