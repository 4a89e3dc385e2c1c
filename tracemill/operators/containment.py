"""Which texts hold which short items word for word, by anchors in place of a comparison of all with all.

White space cuts item and text alike, so what stands between two white spaces of an item is a whole word of every
text that holds it, what stands before its first one ends a word, what stands after its last one begins a word, and an
item without any is a part of a word. Each of these is an equal string between the item and the parts of the words of
the texts. Of an item's parts the one that the fewest documents have is its anchor; documents and items meet at
anchors by their ids, and each text is compared once with all items that it has met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of parts: a whole word, the end of one, the beginning of one, any part of one, any part of a run of white space, nothing.
WORD, END, BEGIN, INSIDE, GAP, EMPTY = "word", "end", "begin", "inside", "gap", "empty"


def _words(text: Column, lengths: dict[str, list[int]]) -> Column:
    """The distinct words of a text and, where items ask for them, its runs of white space and the empty string."""
    words = F.filter(F.array_distinct(F.split(text, r"\s+")), lambda w: w != "")
    gaps = [F.array_distinct(F.regexp_extract_all(text, F.lit(r"\s+"), F.lit(0)))] if lengths.get(GAP) else []
    return F.concat(words, *gaps, *([F.array(F.lit(""))] if lengths.get(EMPTY) else []))


def parts(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item, kind, part of all parts that an item can be anchored by. A null item has none."""
    cut, last = F.split(text, r"\s+"), F.size(F.split(text, r"\s+")) - 1
    part = lambda kind, w: F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), w.alias("part"))
    inner = F.transform(F.slice(cut, 2, F.greatest(last - 1, F.lit(0))), lambda w: part(WORD, w))
    edges = F.array(part(END, F.get(cut, F.lit(0))), part(BEGIN, F.get(cut, last)))
    blank = F.array(part(F.when(F.col(text) == "", EMPTY).otherwise(GAP), F.col(text)))
    every = F.when(F.col(text).rlike(r"^\s*$"), blank).when(last == 0, F.array(part(INSIDE, F.get(cut, F.lit(0))))).when(last > 1, inner).otherwise(edges)
    return items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("item"), F.explode(every).alias("p")).select("item", "p.*").where("part <> '' or kind = 'empty'").distinct()


def _keys(words: DataFrame, lengths: dict[str, list[int]]) -> DataFrame:
    """words with kind and part: each word itself, and such parts of it as have a length that an item's part of the kind has."""
    word, size = F.col("word"), F.length("word")
    of = lambda kind, w: F.struct(F.lit(kind).alias("kind"), w.alias("part"))
    wanted = lambda kind: F.filter(F.array(*map(F.lit, lengths[kind])), lambda n: n <= size)
    of_gap = F.transform(wanted(GAP), lambda n: F.array_distinct(F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: of(GAP, F.substring(word, i, n))))) if lengths.get(GAP) else None
    lists = [F.array(of(WORD, word))]
    if lengths.get(END):
        lists.append(F.transform(wanted(END), lambda n: of(END, F.right(word, n))))
    if lengths.get(BEGIN):
        lists.append(F.transform(wanted(BEGIN), lambda n: of(BEGIN, F.left(word, n))))
    if lengths.get(INSIDE):
        inside = F.transform(wanted(INSIDE), lambda n: F.array_distinct(F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: of(INSIDE, F.substring(word, i, n)))))
        lists.append(F.flatten(inside))
    every = F.concat(*lists)
    if of_gap is not None:
        every = F.when(word.rlike(r"^\s+$"), F.flatten(of_gap)).otherwise(every)
    return words.select("*", F.explode(F.when(word == "", F.array(of(EMPTY, word))).otherwise(every)).alias("k")).select(*words.columns, "k.*")


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id of every document and item whose text it holds, wherever it begins and however short it is.

    doc_id and item_id tell rows apart. Letters count as they are. Null texts hold nothing and null items are held by
    nothing; an empty item is held by every text; items of equal texts are each held. The lengths of the parts of items of
    few words, few, come to the driver; nothing else does. Words, not texts, are looked through for anchors, and of a text
    only its id goes with them; a text is shuffled once.
    """
    own = parts(items, item_id, item_text)
    lengths: dict[str, list[int]] = {}
    for kind, n in own.where(F.col("kind") != WORD).select("kind", F.length("part").alias("n")).distinct().orderBy("kind", "n").collect():
        lengths.setdefault(kind, []).append(n)
    rows = docs.where(F.col(text).isNotNull())
    by_word = rows.select(F.col(doc_id).alias("doc"), F.explode(_words(F.col(text), lengths)).alias("word"))
    # The vocabulary with the number of documents of each word gives each part an upper bound of the documents that have it.
    vocabulary = by_word.groupBy("word").agg(F.count("*").alias("docs"))
    met = _keys(vocabulary, lengths).join(own, ["kind", "part"])
    costs = met.groupBy("item", "kind", "part").agg(F.sum("docs").alias("docs"))
    anchors = costs.groupBy("item").agg(F.min(F.struct("docs", "kind", "part")).alias("a")).select("item", "a.kind", "a.part")
    words = met.join(anchors, ["item", "kind", "part"], "left_semi").select("word", "item").distinct()
    pairs = by_word.join(words, "word").select("doc", "item").distinct()
    texts = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("item_text"))
    held = pairs.join(texts, "item").groupBy("doc").agg(F.collect_list(F.struct("item", "item_text")).alias("items"))
    found = rows.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).join(held, "doc").select("doc", F.explode(F.filter("items", lambda i: F.contains(F.col("text"), i["item_text"]))).alias("i"))
    return found.select(F.col("doc").alias(doc_id), F.col("i.item").alias(item_id))
