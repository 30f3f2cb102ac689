"""Lexical retrieval: postings, BM25 in batch, highlights and snippets.

A batch of queries is one job. Every term of a query must occur (or any of them). The best matches come from blocks of posting lists (``bm25_top``);
where all matches are wanted, the candidates of a query come from its rarest term only and are then checked against the other terms by an
equi-join on (term, document), so a term that stands in a third of all documents is never expanded for each query that holds it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlake.session import in_tasks, spread, staged

K1, B = 1.2, 0.75
MAX_BROADCAST_TERMS = 500_000
MARK = "\u0001"  # never part of a token


def _accents() -> tuple[str, str]:
    """Latin letters with marks and their plain letters, by the rule of canonical decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    kept = [(a, b) for a, b in pairs if a != b and b.isascii() and a == a.lower()]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


ACCENTED, PLAIN = _accents()


def tokens(text: Column | str) -> Column:
    """Runs of letters and digits in lower case without Latin accents; null for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.translate(F.lower(c), ACCENTED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), 0)


def sanitize(query: Column | str) -> Column:
    """Keep ASCII letters, digits, apostrophes and hyphens; single blanks between; trimmed."""
    c = F.col(query) if isinstance(query, str) else query
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^a-zA-Z0-9\s'-]", " "), r"\s+", " "))


def postings(docs: DataFrame, id_col: str, text_col: str, extra_tokens: int = 1) -> DataFrame:
    """``doc_id, term, tf, dl``: one row per term of a document. ``extra_tokens`` counts tokens of other indexed columns.

    Term counts are partially aggregated where a document is read, so only finished counts are shuffled.
    """
    toks = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id").select("doc_id", F.coalesce(tokens("text"), F.array().cast("array<string>")).alias("t"))
    terms = toks.select("doc_id", (F.size("t") + extra_tokens).alias("dl"), F.explode("t").alias("term"))
    return terms.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")).select("doc_id", "term", "tf", "dl")


def corpus_stats(docs: DataFrame, text_col: str, extra_tokens: int = 1) -> DataFrame:
    """One row: ``n_docs, avgdl``."""
    dl = F.coalesce(F.size(tokens(text_col)), F.lit(0))
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.when(dl < 0, 0).otherwise(dl) + extra_tokens).alias("avgdl"))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "query", compat: bool = True) -> DataFrame:
    """``query_id, term, qtf, n_terms`` of the queries that can be matched.

    With ``compat`` a query that holds a hyphen or an apostrophe after sanitizing matches nothing (it is a syntax error in the usual
    full-text grammar); without it such words are split into their tokens.
    """
    clean = queries.select(F.col(id_col).alias("query_id"), sanitize(text_col).alias("q")).where("q != ''")
    if compat:
        clean = clean.where(~F.col("q").rlike("['-]"))
    terms = clean.select("query_id", F.explode(tokens("q")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    return terms.withColumn("n_terms", F.count("*").over(Window.partitionBy("query_id")))


#: Words of the query grammar; they count in upper case only.
_WORDS = "(?:AND|OR|NOT)"


def query_clauses(queries: DataFrame, id_col: str = "query_id", text_col: str = "query", compat: bool = True, mode: str = "all") -> DataFrame:
    """``query_id, clause, term, qtf`` of the queries that can be matched: a document matches if it holds every term of some clause, and none with a ``qtf`` of 0.

    ``mode`` "all" makes one clause of all terms, "any" one of each term. "grammar" reads the words AND (also implied), OR and NOT: OR parts clauses, NOT
    bans the word after it; a query that begins or ends with such a word, or has two in a row, matches nothing. ``compat`` as in ``query_terms``.
    """
    if mode != "grammar":
        terms = query_terms(queries, id_col, text_col, compat)
        clause = F.row_number().over(Window.partitionBy("query_id").orderBy("term")) if mode == "any" else F.lit(1)
        return terms.select("query_id", clause.alias("clause"), "term", F.col("qtf").cast("bigint").alias("qtf"))
    clean = queries.select(F.col(id_col).alias("query_id"), sanitize(text_col).alias("q")).where("q != ''")
    clean = clean.where(~F.col("q").rlike(rf"^{_WORDS}\b|\b{_WORDS}$|\b{_WORDS} {_WORDS}\b"))
    if compat:
        clean = clean.where(~F.col("q").rlike("['-]"))
    parts = clean.select("query_id", F.posexplode(F.split("q", " OR ")).alias("clause", "part"))
    banned = F.flatten(F.transform(F.regexp_extract_all("part", F.lit(r"\bNOT (\S+)"), 1), tokens))
    wanted = tokens(F.regexp_replace("part", r"\bNOT \S+|\bAND\b", " "))
    rows = parts.select("query_id", "clause", F.explode(wanted).alias("term"), F.lit(1).alias("n")).unionByName(parts.select("query_id", "clause", F.explode(banned).alias("term"), F.lit(0).alias("n")))
    return rows.groupBy("query_id", "clause", "term", "n").agg(F.sum("n").alias("qtf")).drop("n")


def scored(tf: Column, dl: Column, df: Column, n: float, avgdl: float) -> Column:
    """The part of a term in a document's score."""
    idf = F.log((F.lit(n) - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, F.lit(1e-6)).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


class Texts:
    """Documents as a source of postings: texts are read and cut once for each batch of searches. ``LexicalIndex`` is the stored form."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, extra_tokens: int = 1):
        self.docs, self.id_col, self.text_col, self.extra = docs, id_col, text_col, extra_tokens

    def found(self, terms: DataFrame, by: str | None = None) -> tuple[DataFrame, int, float]:
        """(``doc_id, [by,] dl, term, tf`` of the asked terms (``term``), the number of documents, their mean length).

        Beside its terms each document leaves a marker row, from which the number of documents and their mean length come. The terms are
        broadcast up to ``MAX_BROADCAST_TERMS``; beyond that Spark joins by shuffle, for which the markers are spread.
        """
        keys = ["doc_id", *([by] if by else [])]
        vocabulary = staged(terms.select("term").distinct(), "vocabulary")
        small = vocabulary.count() <= MAX_BROADCAST_TERMS
        read = spread(self.docs.select(F.col(self.id_col).alias("doc_id"), *([F.col(by)] if by else []), F.col(self.text_col).alias("_text")), "doc_id")
        marker = F.concat(F.lit(MARK), F.pmod(F.xxhash64("doc_id"), F.lit(1024)).cast("string"))
        toks = read.select(*keys, F.coalesce(tokens("_text"), F.array().cast("array<string>")).alias("t"), marker.alias("m"))
        rows = toks.select(*keys, (F.size("t") + self.extra).alias("dl"), F.explode(F.array_append("t", F.col("m"))).alias("term"))
        asked = vocabulary.withColumn("asked", F.lit(True))
        kept = rows.join(F.broadcast(asked) if small else asked, "term", "left").where(F.col("asked") | F.col("term").startswith(MARK))
        post = staged(kept.groupBy(*keys, "dl", "term").agg(F.count("*").alias("tf")), "postings")
        n, total = post.where(F.col("term").startswith(MARK)).agg(F.sum("tf"), F.sum(F.col("dl") * F.col("tf"))).first()
        return post.where(~F.col("term").startswith(MARK)), n or 0, (total or 0) / (n or 1)


def weighted(source, terms: DataFrame, by: str | None = None) -> DataFrame:
    """``doc_id, [by,] term, df, w`` of the asked terms in a source of postings: ``w`` is the term's part of the score."""
    used, n, avgdl = source.found(terms, by)
    used = staged(used, "found")
    df = used.groupBy("term").agg(F.count("*").alias("df"))
    score = scored(F.col("tf"), F.col("dl"), F.col("df"), float(n), avgdl)
    return used.join(F.broadcast(df) if df.count() <= MAX_BROADCAST_TERMS else df, "term").select("doc_id", *([by] if by else []), "term", "df", score.alias("w"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, mode: str = "all", compat: bool = True) -> DataFrame:
    """``query_id, doc_id, rank`` of every match; ``rank`` is negative, lower is better. For the best of each query see ``bm25_top``.

    ``mode`` "all" wants every term of a query, "any" at least one. A term that stands twice in a query counts twice. Documents of equal id are
    one document each; null texts match nothing.
    """
    terms = staged(query_terms(queries, compat=compat), "terms")
    used = weighted(Texts(docs, id_col, text_col), terms)
    if mode == "any":
        hits = terms.join(used, "term")
    else:
        df = used.select("term", "df").distinct()
        whole = terms.join(df, "term", "left").withColumn("ok", F.count("df").over(Window.partitionBy("query_id")) == F.col("n_terms")).where("ok").drop("ok", "df")
        rarest = whole.join(df, "term").groupBy("query_id").agg(F.min(F.struct("df", "term")).alias("r")).select("query_id", F.col("r.term").alias("term"))
        candidates = rarest.join(used.select("term", "doc_id"), "term").select("query_id", "doc_id")
        hits = candidates.join(whole, "query_id").join(used, ["term", "doc_id"])
    agg = hits.groupBy("query_id", "doc_id").agg((-F.sum(F.col("qtf") * F.col("w"))).alias("rank"), F.count("*").alias("n"), F.first("n_terms").alias("n_terms"))
    return (agg if mode == "any" else agg.where("n = n_terms")).select("query_id", "doc_id", "rank")


def bm25_top(
    docs,
    queries: DataFrame,
    id_col: str,
    text_col: str,
    k: int,
    mode: str = "all",
    compat: bool = True,
    exclude: DataFrame | None = None,
    by: str | None = None,
    digits: int = 6,
    postings_per_block: int = 200_000,
    terms_per_block: int = 100_000,
) -> DataFrame:
    """The best ``k`` matches of each query: ``query_id, doc_id, rank, rk``, or the best groups ``query_id, <by>, rank, rk`` by their best document.

    ``docs`` are documents, or a ``LexicalIndex`` of them (then the columns aren't looked at). As ``bm25``, with ``mode`` as in ``query_clauses``, but queries
    of equal terms are scored once, and all queries meet all postings in blocks: documents are dealt by hash into blocks of bounded size, each
    block adds up its posting lists per query and keeps the best k, and a last step keeps the best over all blocks. So no match below the best k of
    its block is ever written out. Up to ``terms_per_block`` query terms go to every task as they are; beyond that they are dealt into blocks too. Ranks are
    rounded to ``digits``, ties go to the lower id. ``exclude`` (``query_id, term``) drops documents that hold such a term. Null ids aren't defined; null
    texts and empty tables match nothing.
    """
    terms = query_clauses(queries, compat=compat, mode=mode)
    if exclude is not None:  # banned in every clause
        banned = exclude.select("query_id", F.explode(tokens("term")).alias("term")).distinct().join(terms.select("query_id", "clause").distinct(), "query_id")
        terms = terms.unionByName(banned.select("query_id", "clause", "term", F.lit(0).cast("bigint").alias("qtf")))
    # The terms of one query text, as the name of all queries that hold the same.
    ts = F.sort_array(F.collect_list(F.struct("clause", "term", "qtf")))
    named = staged(terms.groupBy("query_id").agg(ts.alias("ts")).withColumn("ask", F.sha2(F.to_json("ts"), 256)), "asks")
    asks = named.groupBy("ask").agg(F.first("ts").alias("ts")).select("ask", F.explode("ts").alias("t")).select("ask", "t.*")
    source = docs if hasattr(docs, "found") else Texts(docs, id_col, text_col)
    spark, key = named.sparkSession, by or "doc_id"

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, list, list] = ([], [], [])
        if not a.empty and not b.empty:
            for ask, found, rank in _best_of_block(a, b, key, k, digits):
                out[0].extend([ask] * len(found))
                out[1].extend(found)
                out[2].extend(rank)
        return pd.DataFrame({"ask": pd.Series(out[0], dtype=object), key: pd.Series(out[1], dtype=object), "rank": pd.Series(out[2], dtype=float)})

    def dealt(used: DataFrame, n: int) -> tuple[DataFrame, int]:
        r = max(1, math.ceil(n / postings_per_block), min(spark.sparkContext.defaultParallelism, n // 20_000))
        return used.withColumn("rb", F.pmod(F.xxhash64("doc_id"), F.lit(r)).cast("int")), r

    few = asks.limit(terms_per_block + 1).toPandas()
    if len(few) <= terms_per_block:
        words = spark.createDataFrame([(t,) for t in few["term"].unique().tolist()], "term string")
        used, n_docs, avgdl = source.found(words, by)
        df = {r[0]: r[1] for r in used.groupBy("term").count().collect()}  # no more than the words asked for
        left, r = dealt(used, sum(df.values()))

        def of_block(a: pd.DataFrame) -> pd.DataFrame:
            return block(a.assign(w=_weights(a, df, n_docs, avgdl)), few)

        schema = T.StructType([T.StructField("ask", T.StringType()), T.StructField(key, used.schema[key].dataType), T.StructField("rank", T.DoubleType())])
        best = in_tasks(left, r, "rb").groupBy("rb").applyInPandas(of_block, schema)
    else:
        used = weighted(source, asks, by)
        left, r = dealt(used, used.count())
        q = math.ceil(asks.count() / terms_per_block)
        left = left.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q - 1))))
        right = asks.withColumn("qb", F.pmod(F.xxhash64("ask"), F.lit(q)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(r - 1))))
        schema = T.StructType([T.StructField("ask", T.StringType()), T.StructField(key, used.schema[key].dataType), T.StructField("rank", T.DoubleType())])
        best = in_tasks(left, r * q, "rb", "qb").groupBy("rb", "qb").cogroup(in_tasks(right, r * q, "rb", "qb").groupBy("rb", "qb")).applyInPandas(block, schema)
    if by:
        best = best.groupBy("ask", by).agg(F.min("rank").alias("rank"))
    top = best.withColumn("rk", F.row_number().over(Window.partitionBy("ask").orderBy("rank", key))).where(F.col("rk") <= k)
    return named.select("query_id", "ask").join(top, "ask").select("query_id", key, "rank", "rk")


def _weights(a: pd.DataFrame, df: dict[str, int], n: int, avgdl: float) -> np.ndarray:
    """``scored`` for a block of postings."""
    codes, words = pd.factorize(a["term"])
    have = np.array([df[t] for t in words], float)
    idf = np.log((n - have + 0.5) / (have + 0.5))
    tf, dl = a["tf"].to_numpy(float), a["dl"].to_numpy(float)
    return np.where(idf <= 0, 1e-6, idf)[codes] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _best_of_block(a: pd.DataFrame, b: pd.DataFrame, key: str, k: int, digits: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(ask, keys, ranks) of the best ``k`` in one block of postings ``a`` for each ask of ``b``."""
    ids, first, doc = np.unique(a["doc_id"].to_numpy(), return_index=True, return_inverse=True)
    keys, group = np.unique(a[key].to_numpy()[first], return_inverse=True) if key != "doc_id" else (ids, None)
    codes, words = pd.factorize(a["term"])
    order = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[order], np.arange(len(words) + 1))
    doc, w = doc[order], a["w"].to_numpy()[order]
    place = {t: i for i, t in enumerate(words)}
    b = b.sort_values(["ask", "clause"], kind="stable", ignore_index=True)
    starts = np.flatnonzero(b["ask"].ne(b["ask"].shift()).to_numpy()).tolist() + [len(b)]
    asks, clauses, terms, counts = b["ask"].tolist(), b["clause"].tolist(), b["term"].tolist(), b["qtf"].tolist()
    n, nobody = len(ids), np.empty(0, np.int64)
    for lo, hi in zip(starts, starts[1:]):
        lists = {t: doc[ends[p] : ends[p + 1]] if (p := place.get(t)) is not None else nobody for t in terms[lo:hi]}
        hits = []
        for c in dict.fromkeys(clauses[lo:hi]):
            mine = [i for i in range(lo, hi) if clauses[i] == c]
            wanted = sorted((lists[terms[i]] for i in mine if counts[i]), key=len)
            if not wanted or not len(wanted[0]):
                continue
            held = wanted[0]
            for other in wanted[1:]:
                held = held[np.isin(held, other, kind="table")]
            for i in mine:
                if not counts[i]:
                    held = held[~np.isin(held, lists[terms[i]], kind="table")]
            hits.append(held)
        hit = hits[0] if len(hits) == 1 else np.unique(np.concatenate(hits)) if hits else nobody
        if not len(hit):
            continue
        score = np.zeros(n)
        for i in range(lo, hi):
            p = place.get(terms[i])
            if counts[i] and p is not None:
                score[doc[ends[p] : ends[p + 1]]] += counts[i] * w[ends[p] : ends[p + 1]]  # a document is once in a list
        hit = np.sort(hit)
        rank = np.round(-score[hit], digits) + 0.0
        ordered = np.argsort(rank, kind="stable")
        hit, rank = hit[ordered], rank[ordered]
        if group is not None:  # the first document of each group, groups of equal rank in their own order
            g, at = np.unique(group[hit], return_index=True)
            ordered = np.argsort(rank[at], kind="stable")[:k]
            yield asks[lo], keys[g[ordered]], rank[at][ordered]
        else:
            yield asks[lo], keys[hit[:k]], rank[:k]


def top_per_query(rows: DataFrame, order: list[Column], k: int | Column, name: str = "rk") -> DataFrame:
    """The best ``k`` rows of each query with their 1-based place; a limit on row_number is also applied before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def highlight(rows: DataFrame, text_col: str, terms_col: str, window: int = 150) -> DataFrame:
    """``highlighted`` (terms in mark tags) and ``snippet`` (the surroundings of the terms) for each row.

    ``terms_col`` holds the folded terms of the row's query. Without a match the snippet is the first ``2 * window`` characters.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("highlighted", T.StringType()), T.StructField("snippet", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = [(t, set(ts if ts is not None else ())) for t, ts in zip(pdf[text_col], pdf[terms_col], strict=True)]
            yield pdf.assign(highlighted=[mark_terms(*p) for p in pairs], snippet=[snippet(*p, window) for p in pairs])

    return rows.mapInPandas(run, schema)


_FOLD = str.maketrans(ACCENTED, PLAIN)
_TOKEN = re.compile(r"[^\W_]+")
GAP = " <span class='snippet-gap'>…</span> "


def _places(text: str, terms: set[str]) -> list[tuple[int, int]]:
    """(start, end) of the tokens of ``text`` whose folded form is in ``terms``."""
    return [m.span() for m in _TOKEN.finditer(text) if m[0].lower().translate(_FOLD) in terms]


def _marked(text: str, lo: int, hi: int, places: list[tuple[int, int]]) -> str:
    """``text[lo:hi]`` with the places in it wrapped in mark tags."""
    out, at = [], lo
    for a, b in places:
        out += [text[at:a], "<mark>", text[a:b], "</mark>"]
        at = b
    return "".join([*out, text[at:hi]])


def mark_terms(text: str | None, terms: set[str]) -> str | None:
    """``text`` with each token whose folded form is in ``terms`` wrapped in mark tags."""
    return None if text is None else _marked(text, 0, len(text), _places(text, terms))


def snippet(text: str | None, terms: set[str], window: int = 150) -> str | None:
    """The matched tokens with ``window`` characters of text on either side, what touches in one piece, an ellipsis where text is left out.

    Distances are those of the text, not of its marked form. A token that the edge of a piece falls into is a whole match of its own, so pieces never
    cut a mark.
    """
    if text is None:
        return None
    places = _places(text, terms)
    if not places:
        return text[: 2 * window]
    starts, ends = (np.array(x) for x in zip(*places, strict=True))
    lo, hi = np.maximum(starts - window, 0), np.minimum(ends + window, len(text))
    first = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])  # ends rise with starts, so only neighbours can touch
    pieces = []
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(places)], strict=True):
        a, b = int(lo[i]), int(hi[j - 1])
        pieces.append(("…" if a else "") + _marked(text, a, b, places[i:j]) + ("…" if b < len(text) else ""))
    return GAP.join(pieces)
