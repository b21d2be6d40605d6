"""Links between texts: items held word for word, and aliases given as patterns, found in one pass over each text.

Small sets of items and aliases, measured first, go to the texts as an Aho-Corasick automaton; larger ones are dealt
into sets that each are small enough, one pass a set. Long items, of which a set is too large for that, meet the texts
by grams and a shuffle. Only the first place of an item or alias in a text is reported; null and empty ones are held
by no text, and a null text holds none. Places are code points from 0, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.sources.batches import sliced
from lodestone.sources.staging import staged

#: So many characters of items, and so many aliases, make one automaton.
CHARS, ALIASES = 2_000_000, 5_000
#: Items shorter than this are looked for one by one: an automaton would stop at nearly every character.
TINY_ITEM = 3
GRAM = 16


def _dealt(rows: DataFrame, size: str, limit: int, key: str) -> tuple[DataFrame, int]:
    """rows with a column set_, and the number of sets of about so much each: what one pass collects is bounded."""
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    sets = max(1, -(-int(total) // limit))
    return rows.withColumn("set_", F.pmod(F.xxhash64(key), F.lit(sets))), sets


def _of_kind(texts: DataFrame, key: str) -> T.DataType:
    return texts.schema[key].dataType


def held(texts: DataFrame, key: str, text: str, items: DataFrame, limit: int | None = None) -> DataFrame:
    """(key, c, start): the first place of each different item (c) that a text holds, by an automaton for each set of items."""
    rows, sets = _dealt(items.select("c", F.length("c").alias("size_")), "size_", limit or CHARS, "c")
    rows = staged(rows, "links-items") if sets > 1 else rows
    docs = texts.select(key, F.col(text).alias("text_")).filter("text_ is not null")
    schema = T.StructType([T.StructField(key, _of_kind(texts, key)), T.StructField("c", T.StringType()), T.StructField("start", T.LongType())])
    found = None
    for k in range(sets):
        # As many characters as the limit, by their count.
        shared = texts.sparkSession.sparkContext.broadcast([r.c for r in rows.filter(F.col("set_") == k).select("c").collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for c in shared.value:
                if len(c) >= TINY_ITEM:
                    automaton.add_word(c, c)
            automaton.make_automaton()
            tiny = [c for c in shared.value if len(c) < TINY_ITEM]
            for b in sliced(batches, 1):
                row, item, start = [], [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    first = {c: at for c in tiny if (at := t.find(c)) >= 0}
                    if len(automaton):
                        for last, c in automaton.iter(t):
                            if c not in first:
                                first[c] = last + 1 - len(c)
                    row += [i] * len(first)
                    item += first.keys()
                    start += first.values()
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(item, pa.string()), pa.array(start, pa.int64())], names=[key, "c", "start"])

        part = docs.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def by_grams(texts: DataFrame, key: str, text: str, items: DataFrame, gram: int = GRAM) -> DataFrame:
    """held() of items (c) of 2 * gram - 1 characters or more, any number of them.

    Wherever a text holds such an item, one of the item's first gram grams starts at a multiple of gram in the text:
    texts give one gram in gram places, items their first ones, and only where they meet is looked.
    """
    docs = texts.select(key, F.xxhash64(F.col(key).cast("string"), text).alias("id_"), F.col(text).alias("text_")).filter("text_ is not null")
    chunks = F.array_distinct(F.regexp_extract_all("text_", F.lit(f"(?s).{{{gram}}}"), F.lit(0)))
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.lit(gram)), lambda i: F.substring(F.col("c"), i, F.lit(gram)))).alias("g")
    met = docs.select("id_", F.explode(chunks).alias("g")).join(items.select("c", ends).distinct(), "g").select("id_", "c").distinct()
    at = F.instr(F.col("text_"), F.col("c"))
    return met.join(docs, "id_").withColumn("at_", at).filter("at_ > 0").select(key, "c", (F.col("at_") - 1).cast("long").alias("start"))


def contained(texts: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item: str, limit: int | None = None, gram: int = GRAM) -> DataFrame:
    """JN5, STR13, TOP3: (key, item_key, start): the first place of each item that a text holds word for word, items of any length.

    Items that are equal are looked for once; a key that several texts or items have gets the least place.
    """
    wanted = items.select(F.col(item_key).alias("item_id_"), F.col(item).alias("c")).filter("length(c) > 0")
    different = wanted.select("c").distinct()
    long = F.length("c") >= 2 * gram - 1
    if different.filter(long).agg(F.coalesce(F.sum(F.length("c")), F.lit(0))).first()[0] <= (limit or CHARS):
        found = held(texts, key, text, different, limit)
    else:
        found = held(texts, key, text, different.filter(~long), limit).unionByName(by_grams(texts, key, text, different.filter(long), gram))
    return found.join(wanted, "c").groupBy(key, F.col("item_id_").alias(item_key)).agg(F.min("start").alias("start"))


def kind_of(text: str, start: str, end: str, critical: str, reach: int):
    """STR11: criticism where a critical pattern stands within reach of a place, else citation."""
    first = F.greatest(F.col(start) - reach, F.lit(0))
    near = F.substring(F.col(text), first.cast("int") + 1, (F.col(end) + reach - first).cast("int"))
    return F.when(near.rlike(critical), "criticism").otherwise("citation")


def linked(texts: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item: str, critical: str, reach: int = 400) -> DataFrame:
    """CMP6: (key, item_key, start, kind) of contained()."""
    lengths = items.select(item_key, F.length(item).alias("n_")).dropDuplicates([item_key])
    found = contained(texts, key, text, items, item_key, item).join(lengths, item_key).withColumn("end_", F.col("start") + F.col("n_"))
    return found.join(texts.select(key, F.col(text).alias("text_")), key).select(key, item_key, "start", kind_of("text_", "start", "end_", critical, reach).alias("kind"))


def factors(pattern: str) -> set[str] | None:
    """Literals of which every match of a pattern holds one, in lower case of ASCII; None if there are no such ones.

    Of a sequence the part with the longest shortest literal speaks; alternatives speak together.
    """
    from re import _constants, _parser

    def best(found: list[set[str]]) -> set[str] | None:
        return max(found, key=lambda s: (min(map(len, s)), -len(s)), default=None)

    def of(items) -> set[str] | None:
        found, run = [], []
        for op, value in [*items, (None, None)]:
            if op is _constants.LITERAL:
                run.append(chr(value))
                continue
            if run:
                found.append({"".join(run)})
                run = []
            part = None
            if op is _constants.BRANCH:
                parts = [of(b) for b in value[1]]
                part = None if None in parts else set().union(*parts)
            elif op is _constants.SUBPATTERN:
                part = of(value[3])
            elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT, _constants.POSSESSIVE_REPEAT) and value[0] > 0:
                part = of(value[2])
            elif op is _constants.ATOMIC_GROUP:
                part = of(value)
            if part:
                found.append(part)
        return best(found)

    found = of(_parser.parse(pattern, re.IGNORECASE | re.ASCII))
    return None if found is None else {f.encode().lower().decode() for f in found}


def alias_links(texts: DataFrame, key: str, text: str, aliases: DataFrame, limit: int | None = None) -> DataFrame:
    """JN5: (key, alias, start, end, match): the first match of each alias (alias, owner, pattern) in each text but the owner's.

    Case of ASCII letters is ignored. An automaton over literals that each pattern's matches must hold tells in one
    pass which patterns to try on a text; a pattern without such a literal is tried on all. A pattern is Python's, and
    a faulty one stops the query before it runs. owner is of the key's kind; null owns nothing.
    """
    limit = limit or ALIASES
    rows, sets = _dealt(aliases.select("alias", "owner", "pattern", F.lit(1).alias("one_")).filter("pattern is not null"), "one_", limit, "alias")
    rows = staged(rows, "links-aliases") if sets > 1 else rows
    docs = texts.select(key, F.col(text).alias("text_")).filter("text_ is not null")
    names = [key, "alias", "start", "end", "match"]
    kinds = [_of_kind(texts, key), aliases.schema["alias"].dataType, T.LongType(), T.LongType(), T.StringType()]
    types = [to_arrow_type(kind) for kind in kinds[1:]]
    found = None
    for k in range(sets):
        asked = [(r.alias, r.owner, r.pattern, factors(r.pattern)) for r in rows.filter(F.col("set_") == k).collect()]
        shared = texts.sparkSession.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            asked = shared.value
            patterns = [re.compile(p, re.IGNORECASE | re.ASCII) for _, _, p, _ in asked]
            always = [i for i, a in enumerate(asked) if a[3] is None]
            by: dict[str, list[int]] = {}
            for i, a in enumerate(asked):
                for f in a[3] or ():
                    by.setdefault(f, []).append(i)
            automaton = ahocorasick.Automaton()
            for f, on in by.items():
                automaton.add_word(f, on)
            automaton.make_automaton()
            for b in sliced(batches, 1):
                out = []
                for row, (id_, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                    tried = set(always)
                    if len(automaton):
                        for _, on in automaton.iter(t.encode().lower().decode()):
                            tried.update(on)
                    for i in sorted(tried):
                        if (asked[i][1] is None or asked[i][1] != id_) and (m := patterns[i].search(t)):
                            out.append((row, asked[i][0], m.start(), m.end(), m[0]))
                columns = [[o[k] for o in out] for k in range(5)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, kind) for c, kind in zip(columns[1:], types, strict=True))], names=names)

        part = docs.mapInArrow(run, T.StructType([T.StructField(n, kind) for n, kind in zip(names, kinds, strict=True)]))
        found = part if found is None else found.unionByName(part)
    return found


def alias_mentions(texts: DataFrame, key: str, text: str, aliases: DataFrame, critical: str, reach: int = 400) -> DataFrame:
    """CMP6: alias_links() with the kind of each."""
    found = alias_links(texts, key, text, aliases)
    return found.join(texts.select(key, F.col(text).alias("text_")), key).select(key, "alias", "start", "end", "match", kind_of("text_", "start", "end", critical, reach).alias("kind"))
