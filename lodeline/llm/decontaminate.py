"""Benchmark passages in documents, also with other numbers, names and units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import staged

#: Words of a window, and words an item needs to be looked for within texts; shorter ones are only whole texts.
WINDOW = 8
LEAST_WORDS = 3
#: Share of an item's windows that a document must hold.
COVERAGE = 0.3
#: Benchmark windows up to which they are broadcast (about 30 MB); more are joined by a shuffle.
BROADCAST_ROWS = 200_000

#: Private characters: number, unit and name placeholders, and the mark inside a number.
NUMBER, UNIT, NAME, INNER = "\ue000", "\ue001", "\ue002", "\ue003"
#: Units that may follow a number.
UNITS = (
    "mm cm dm m km in ft yd mi mg g kg t oz lb lbs ml cl dl l kl ms s sec secs second seconds min mins minute minutes "
    "h hr hrs hour hours day days week weeks month months year years hz khz mhz ghz w kw mw kwh j kj cal kcal v a ma "
    "c f k pa kpa bar mph kmh usd eur gbp dollar dollars cent cents euro euros percent bytes kb mb gb tb "
    "meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres"
)
#: What separates words: ASCII and Latin-1 marks one by one, which a pattern looks up in a table, and ranges of general and CJK punctuation and white space.
_MARKS = "".join(f"\\x{c:02X}" for c in range(256) if not (chr(c).isalnum() and chr(c) not in "²³¹¼½¾"))
_FAR = r"[ -／&&[  -⁯⸀-⹿　-〿︰-﹏！-／]]"
_GAP = f"(?:[{_MARKS}]|{_FAR})+"
#: Numbers in words.
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
)
_NUMBER_PATTERN = "|".join(sorted(NUMBER_WORDS.split(), key=lambda u: (-len(u), u)))
#: Those that another number word may follow within one number.
_LEADING = "|".join(w for w in NUMBER_WORDS.split() if w.endswith(("ty", "hundred", "thousand", "million", "billion")))
_UNIT_PATTERN = "|".join(sorted(UNITS.split(), key=lambda u: (-len(u), u)))


def typed_tokens(text: Column) -> Column:
    """The words of a text in lower case, numbers, units and names marked by a first character.

    A name is a capitalised word, wherever it stands, or several that follow
    each other; a number is written in digits or as words, see NUMBER_WORDS.
    Punctuation ends a word and is left out.
    """
    # Each pattern first asks for a character that few places hold, and looks behind only there.
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NUMBER}-{INNER}]", " ")
    t = F.regexp_replace(t, r"[.,](?<=\p{N}.)(?=\p{N})", INNER)
    t = F.regexp_replace(t, r"\p{Lu}(?<![\p{L}\p{N}].)\p{Ll}+(?![\p{L}\p{N}])", NAME + "$0")
    t = F.lower(F.regexp_replace(t, rf"({NAME}\p{{L}}+) (?={NAME})", f"$1{INNER}"))
    t = F.regexp_replace(t, rf"[ -](?<=(?<!\p{{L}})(?:{_LEADING})[ -])(?=(?:{_NUMBER_PATTERN})(?!\p{{L}}))", INNER)
    t = F.regexp_replace(t, rf"\p{{N}}(?<![\p{{L}}\p{{N}}{INNER}{NAME}].)[\p{{N}}{INNER}]*", NUMBER + "$0")
    t = F.regexp_replace(t, rf"({NUMBER}[\p{{N}}{INNER}]+)[ -]?({_UNIT_PATTERN})(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2")
    words = F.array_remove(F.split(t, _GAP), "")
    plain = lambda w: ~F.startswith(w, F.lit(NAME)) & ~F.startswith(w, F.lit(NUMBER))
    in_words = lambda w: w.isin(NUMBER_WORDS.split()) | (F.contains(w, F.lit(INNER)) & plain(w))
    return F.transform(words, lambda w: F.when(in_words(w), F.concat(F.lit(NUMBER), w)).otherwise(w))


def _is_slot(token: Column) -> Column:
    """Whether a word begins with one of the marks, which follow each other."""
    return (token >= NUMBER) & (token < INNER)


def _template(token: Column) -> Column:
    return F.when(_is_slot(token), F.substr(token, F.lit(1), F.lit(1))).otherwise(token)


def _heavy(words: Column, size: Column, window: int) -> Column:
    """Whether a window has too few plain words to be told by its template."""
    return 2 * F.size(F.filter(words, lambda t: ~_is_slot(t))) < F.least(size, F.lit(window))


def _windows(rows: DataFrame, lengths: list[int], window: int) -> DataFrame:
    """``rows`` (tokens, and others) with w, at and h, a window's size, position and hash, for every window.

    The hash is the template's, or that of the words themselves where most are slots.
    An exploded row repeats all other columns: ``rows`` should have few and small ones beside its tokens, which are left out.
    """
    typed = rows.withColumn("hashes", F.transform("tokens", lambda t: F.xxhash64(_template(t))))
    shift = lambda k: F.zip_with("hashes", F.slice("hashes", F.lit(k + 1), F.size("hashes")), lambda a, b: F.xxhash64(a, b))

    def of(size: int) -> DataFrame:
        """Hashes of all windows of a size: of two halves where it is a power of two, else of its words one by one."""
        if size & (size - 1) == 0:
            made, k = typed, 1
            while k < size:
                made, k = made.withColumn("hashes", shift(k)), 2 * k
            whole = F.slice("hashes", F.lit(1), F.greatest(F.size("tokens") - (size - 1), F.lit(0)))
        else:
            made = typed
            starts = F.when(F.size("hashes") >= size, F.sequence(F.lit(1), F.size("hashes") - (size - 1))).otherwise(F.array().cast("array<int>"))
            whole = F.transform(starts, lambda i: F.xxhash64(F.slice("hashes", i, F.lit(size))))
        slots = F.transform("tokens", lambda t: _is_slot(t).cast("int"))
        made, k = made.withColumn("slots", slots), 1
        while 2 * k <= size:
            made, k = made.withColumn("slots", F.zip_with("slots", F.slice("slots", F.lit(k + 1), F.size("slots")), lambda a, b: a + b)), 2 * k
        if k < size:
            made = made.withColumn("slots", F.zip_with("slots", F.slice("slots", F.lit(size - k + 1), F.size("slots")), lambda a, b: a + b))
        # Of overlapping halves the sum is no less than the count, so that no heavy window is passed over.
        own = lambda i: F.slice("tokens", i + 1, F.lit(size))
        heavy = lambda i: (2 * (size - F.get("slots", i)) < min(size, window)) & _heavy(own(i), F.lit(size), window)
        some = 2 * (size - F.array_max("slots")) < min(size, window)  # most texts have none, and skip the search
        whole = F.when(some, F.transform(whole, lambda h, i: F.when(heavy(i), F.xxhash64(own(i), F.lit(size))).otherwise(h))).otherwise(whole)
        kept = [c for c in rows.columns if c != "tokens"]
        return made.select(*kept, F.lit(size).alias("w"), F.posexplode(whole).alias("at", "h"))

    parts = [of(size) for size in lengths if size >= LEAST_WORDS]
    if min(lengths) < LEAST_WORDS:  # texts below that are one window
        n = F.size("tokens")
        kept = [c for c in rows.columns if c != "tokens"]
        parts.append(rows.where((n > 0) & (n < LEAST_WORDS)).select(*kept, n.alias("w"), F.lit(0).alias("at"), F.xxhash64("tokens", n).alias("h")))
    return reduce(DataFrame.unionByName, parts)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, window: int = WINDOW) -> DataFrame:
    """Pairs (doc_id, item_id, coverage, matched_windows, item_windows, reparameterised) of documents that hold an item.

    Texts become templates: numbers, units and names are placeholders of their
    type. Windows of eight words are hashed and joined, and compared word by
    word where hashes agree; those of which more than half are placeholders
    agree only with the same words. An item that has no others is also looked
    for by longer windows, of 16 words or its length, as templates if they
    have four plain words. Coverage is the better of that of the template
    windows and that of all, for each size of window.
    Windows that line up are one occurrence. A value of the item that is both
    kept and replaced there is in conflict; its windows count only where all
    of their slots hold the item's own values. Different values may be
    replaced by one, and a value by several. A pair is returned if such
    windows hold ``coverage`` of the item's; ``reparameterised`` says that no
    occurrence has the item's own values throughout.

    Items are looked for as they are written, in lower case, and with a lower
    first letter: a capital makes a name of a word. An item with fewer than
    three words is found where it is the whole text, word for word; those with
    fewer than eight are one window of their length. Null and blank texts have
    no windows; very long texts count whole. Equal rows of ``benchmark`` count
    once; rows of one item_id with different texts are looked for one by one
    and give a pair each. Repeated documents are one document; those without a
    doc_id can't be named and are left out. Other columns are not read. An
    empty table on either side gives no pairs.
    """
    trimmed = F.regexp_replace("item_text", r"^\s+", "")
    lowered = F.concat(F.lower(F.substr(trimmed, F.lit(1), F.lit(1))), F.substr(trimmed, F.lit(2)))
    forms = F.array(*(typed_tokens(t) for t in (F.col("item_text"), F.lower("item_text"), lowered)))
    items = (
        benchmark.select(F.col("item_id").alias("item_id"), F.col("text").cast("string").alias("item_text"))
        .where("item_text is not null")
        .distinct()
        .select("item_id", F.xxhash64("item_text").alias("version"), F.explode(F.array_distinct(forms)).alias("tokens"))
        .where(F.size("tokens") > 0)
    )
    n = F.size("tokens")
    starts = F.sequence(F.lit(1), n - F.least(n, F.lit(window)) + 1)
    only_heavy = F.forall(starts, lambda i: _heavy(F.slice("tokens", i, F.least(n, F.lit(window))), n, window))
    longer = F.when((n > window) & only_heavy, F.array(F.least(n, F.lit(2 * window)))).otherwise(F.array().cast("array<int>"))
    items = items.withColumn("sizes", F.concat(F.array(F.least(n, F.lit(window))), longer))
    longs = [r[0] for r in items.select(F.explode("sizes").alias("n")).distinct().orderBy("n").collect()]
    longs = longs or [window]
    words = F.slice("tokens", F.col("at") + 1, F.col("w"))
    items = items.withColumn("form", F.xxhash64("tokens"))
    keyed = _windows(items.select("item_id", "version", "form", "tokens"), longs, window).join(items, ["item_id", "version", "form"])
    wanted = keyed.where(F.array_contains("sizes", F.col("w"))).select(
        "item_id", "version", F.col("w").alias("size"), F.col("at").alias("item_at"), "h", words.alias("item_words"), _heavy(words, F.col("w"), window).alias("heavy")
    )
    item_windows = staged(docs.sparkSession, wanted.where((F.col("size") <= window) | ~F.col("heavy")).distinct(), "item-windows")
    plain_at = F.when(~F.col("heavy"), F.col("item_at"))
    totals = item_windows.groupBy("item_id", "version", "size").agg(F.countDistinct(plain_at).alias("plain_windows"), F.countDistinct("item_at").alias("all_windows"))
    known = item_windows.count()
    hint = F.broadcast if known <= BROADCAST_ROWS else (lambda df: df)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = _windows(texts.select("doc_id", typed_tokens(F.col("text")).alias("tokens")), longs, window)
    pairs = made.join(hint(item_windows.select("item_id", "version", "size", "item_at", "h")), "h").where(F.col("w") == F.col("size"))
    hits = staged(docs.sparkSession, pairs.select("doc_id", "at", "w", "item_id", "version", "item_at"), "window-hits")
    ids = hits.select("doc_id").distinct()
    held = texts.join(F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids, "doc_id", "left_semi")
    found = (
        hits.join(held.select("doc_id", typed_tokens(F.col("text")).alias("tokens")), "doc_id")
        .select("doc_id", "item_id", "version", F.col("w").alias("size"), "item_at", "at", words.alias("doc_words"))
        .join(hint(item_windows), ["item_id", "version", "size", "item_at"])
        .where(F.when(F.col("heavy"), F.col("item_words") == F.col("doc_words")).otherwise(F.transform("item_words", _template) == F.transform("doc_words", _template)))
    )
    slots = F.filter(F.arrays_zip("item_words", "doc_words"), lambda z: _is_slot(z["item_words"]))
    occurrences = (
        found.select("doc_id", "item_id", "version", "size", "item_at", "heavy", (F.col("at") - F.col("item_at")).alias("start"), slots.alias("slots"))
        .groupBy("doc_id", "item_id", "version", "size", "start")
        .agg(F.collect_set(F.struct("item_at", "heavy", F.col("slots").alias("own"))).alias("held"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    )
    differs = lambda z: z["item_words"] != z["doc_words"]
    changed = F.exists("slots", differs)
    values = lambda test: F.transform(F.filter("slots", test), lambda z: z["item_words"])
    split = occurrences.withColumn("conflicts", F.array_intersect(values(differs), values(lambda z: ~differs(z))))
    counts = lambda x: ~F.exists(x["own"], differs) | ~F.exists(x["own"], lambda z: F.array_contains("conflicts", z["item_words"]))
    per_pair = split.withColumn("held", F.filter("held", counts)).select("doc_id", "item_id", "version", "size", F.explode("held").alias("held"), changed.alias("changed"))
    counted = per_pair.select("doc_id", "item_id", "version", "size", "held.item_at", "held.heavy", "changed").groupBy("doc_id", "item_id", "version", "size").agg(
        F.countDistinct(plain_at).alias("plain"), F.countDistinct("item_at").alias("all"), F.min("changed").alias("changed")
    )
    share = lambda part, of: F.struct(
        F.when(F.col(of) > 0, F.col(part) / F.col(of)).otherwise(0.0).alias("coverage"), F.col(part).alias("matched_windows"), F.col(of).alias("item_windows")
    )
    best = F.greatest(share("plain", "plain_windows"), share("all", "all_windows"))
    return (
        counted.join(hint(totals), ["item_id", "version", "size"])
        .select("doc_id", "item_id", "version", best.alias("best"), F.col("changed").alias("reparameterised"), F.col("size"))
        .groupBy("doc_id", "item_id", "version")
        .agg(F.max(F.struct("best.coverage", -F.col("size"), "best.matched_windows", "best.item_windows", "reparameterised")).alias("top"))
        .select("doc_id", "item_id", "top.coverage", "top.matched_windows", "top.item_windows", "top.reparameterised")
        .where(F.col("coverage") >= coverage)
    )
