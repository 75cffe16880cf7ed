"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Tokens are runs of letters and digits, in lower case; punctuation and symbols only separate. In
scripts written without spaces (Han, kana, Thai, Lao) each letter is a token. A number, a capitalised word inside a sentence, and a unit after a number become the placeholders
``<num>``, ``<name>`` and ``<unit>``. Windows of five placeholder tokens, at least three of them
words, are hash-joined between documents and benchmark items, so a question whose numbers, names
or units were replaced still meets its template.

The same windows are also joined word for word in lower case, without marks of names, so a copy in
other case, in which no name can be told, is found as well. White space before a name may be any.

Slot consistency: on one alignment of a document with an item, a value of the item must always
stand for the same value of the document. Template windows with a slot whose value breaks this
count for nothing; windows that are equal word for word always count. A document is linked to an
item when the windows found either way cover at least half of the item's windows.

Items that share an instruction would join every document that has it. So only the rarest windows
of an item look for documents, as many as a link cannot do without; what they bring together is then
checked on all windows of the item.

Before the join, a bitmap of the items' window hashes (16 bits a window, at most 16 MB) removes
nearly all windows of documents inside the scan. It only removes windows that cannot join, and
its size depends on the benchmark, not on the documents.

Only linked documents are returned, one row per document and item. Rows that share an id (null
is an id as well) are judged as one document. Null text counts as empty. Items of fewer than five
tokens, or without a window of three words, are too short to be evidence and link to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tapeloom.llm.common import own_names, read
from tapeloom.plans.stage import written

WINDOW, WORDS, COVERAGE = 5, 3, 0.5
#: Marks a capitalised word, and the point or comma inside a number.
NAME, POINT = "\ue000", "\ue001"
#: Letters of scripts without spaces between words, as Java and RE2 both read it.
UNSPACED = r"[\x{0E00}-\x{0EFF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]"
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonnes "
    "pound pounds lb lbs ounce ounces oz ml l litre litres liter liters gallon gallons s ms sec second seconds min minute "
    "minutes h hour hours day days week weeks month months year years percent degrees celsius fahrenheit kelvin hz khz mhz "
    "ghz watt watts kw kwh volt volts joule joules cent cents dollar dollars euro euros usd eur gbp kmh mph"
).split()


def tokens(text: Column) -> Column:
    """Lower-case tokens; a name keeps its mark."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    text = F.regexp_replace(text, r"([^.!?:;\s]\s+)(\p{Lu}\p{Ll})", f"$1{NAME}$2")
    text = F.regexp_replace(text, r"([0-9])[.,]([0-9])", f"$1{POINT}$2")
    text = F.regexp_replace(F.lower(text), r"([0-9])(\p{L})", "$1 $2")
    text = F.regexp_replace(text, f"({UNSPACED})", " $1 ")
    return F.array_remove(F.split(text, rf"[^\p{{L}}\p{{N}}{NAME}{POINT}]+"), "")


def _number(token: Column) -> Column:
    return (token >= "0") & (token < ":")


def template(words: Column) -> Column:
    """Tokens with numbers, names and units replaced by their placeholders."""

    def one(token, i):
        after_number = F.coalesce(_number(F.get(words, i - 1)), F.lit(False))
        return (
            F.when(_number(token), "<num>")
            .when(token.startswith(NAME), "<name>")
            .when(token.isin(UNITS) & after_number, "<unit>")
            .otherwise(token)
        )

    return F.transform(words, one)


def _tokenised(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    words = df.select(F.col(key).alias(name), tokens(F.col(text)).alias("__words"))
    return words.select(name, "__words", template(F.col("__words")).alias("__template"), _plain(F.col("__words")).alias("__plain"))


def _plain(words: Column) -> Column:
    return F.transform(words, lambda w: F.ltrim(w, F.lit(NAME)))


def _spread(df: DataFrame, position: str) -> DataFrame:
    """A row per window start, with the hashes of the window's template and of its plain words."""
    last = F.size("__template") - WINDOW
    # a filter on the length would be pushed below and tokenise every text twice
    starts = df.withColumn(position, F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))
    parts = [F.get("__template", F.col(position) + k) for k in range(WINDOW)]
    plain = [F.get("__plain", F.col(position) + k) for k in range(WINDOW)]
    return starts.withColumn("__hash", F.xxhash64(*parts)).withColumn("__hash_plain", F.xxhash64(*plain))


def _cut(df: DataFrame, key: str, position: str, values: str, flag: str) -> DataFrame:
    """A row per window and form, ``flag`` on templates; a window without slots is its own template."""
    at = F.col(position) + 1
    form = F.struct(F.col("__hash"), F.slice("__template", at, WINDOW).alias("__window"), F.lit(True).alias(flag))
    plain = F.struct(F.col("__hash_plain").alias("__hash"), F.slice("__plain", at, WINDOW).alias("__window"), F.lit(False).alias(flag))
    forms = F.when(form["__window"] == plain["__window"], F.array(form)).otherwise(F.array(form, plain))
    both = df.select(key, position, F.slice("__words", at, WINDOW).alias(values), F.explode(forms).alias("__form"))
    return both.select(key, position, "__form.*", values)


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    spread = _spread(_tokenised(benchmark, item_id, text, "item_id"), "__at")
    window = F.slice("__template", F.col("__at") + 1, WINDOW)
    slots = F.size(F.filter(window, lambda w: w.startswith("<")))
    return _cut(spread.filter(F.lit(WINDOW) - slots >= WORDS), "item_id", "__at", "__theirs", "__their_template")


def _bitmap(items: DataFrame) -> tuple[Column, int]:
    """The set bits of the items' hashes as an array of 64-bit words, and the number of bits."""
    bits = 1 << 12
    while bits < min(16 * items.count(), 1 << 27):
        bits *= 2
    spot = F.col("__hash").bitwiseAND(F.lit(bits - 1))
    set_ = items.select(F.shiftright(spot, 6).alias("slot"), F.call_function("shiftleft", F.lit(1).cast("bigint"), spot.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    words = set_.groupBy("slot").agg(F.bit_or("bit").alias("bit"))
    every = items.sparkSession.range(bits // 64).withColumnRenamed("id", "slot").join(words, "slot", "left")
    listed = F.sort_array(F.collect_list(F.struct("slot", F.coalesce("bit", F.lit(0).cast("bigint")).alias("bit"))))
    return every.agg(listed["bit"].alias("map")).scalar(), bits


def _rarest(items: DataFrame, coverage: float) -> DataFrame:
    """Of each item the windows that fewest items have; a link must cover one of them.

    A link covers at least ``coverage`` of n positions, so any n - ceil(coverage * n) + 1 of them meet it.
    """
    shared = items.groupBy("__hash").agg(F.count_distinct(F.struct("item_id")).alias("__items"))
    spots = items.join(shared, "__hash").groupBy("item_id", "__at").agg(F.max("__items").alias("__items"))
    each = W.partitionBy("item_id")
    ranked = spots.select(
        "item_id", "__at", F.row_number().over(each.orderBy("__items", "__at")).alias("__rank"), F.count("*").over(each).alias("__n")
    )
    kept = ranked.filter(F.col("__rank") <= F.col("__n") - F.ceil(F.lit(coverage) * F.col("__n")) + 1)
    return _null_safe(items, kept.select("item_id", "__at"), ["item_id", "__at"], "left_semi")


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Windows of documents that equal a window of an item, with the words behind both.

    Pairs that cannot reach ``coverage`` may be left out; of the others every window is there.
    """
    bitmap, bits = _bitmap(items)
    spread = _spread(_tokenised(docs, doc_id, text, "doc_id"), "__from")

    def held(name: str) -> Column:
        spot = F.col(name).bitwiseAND(F.lit(bits - 1))
        word = F.get(bitmap, F.shiftright(spot, 6).cast("int"))
        return F.call_function("shiftright", word, spot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    found = _cut(spread.filter(held("__hash") | held("__hash_plain")), "doc_id", "__from", "__ours", "__our_template")
    window = ["__hash", "__window"]
    found = written(found.join(items.select(*window).distinct(), window, "left_semi"), "windows")
    pairs = found.select("doc_id", *window).distinct().join(_rarest(items, coverage).select("item_id", *window), window)
    pairs = written(pairs.select("doc_id", "item_id").distinct(), "pairs")
    asked = _null_safe(pairs, items, ["item_id"], "inner")
    return _null_safe(asked, found, ["doc_id", *window], "inner").withColumn("__line", F.col("__from") - F.col("__at"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    coverage: float = COVERAGE,
) -> DataFrame:
    """``doc_id, item_id, matched_windows, item_windows, slots, changed_slots`` of each link.

    ``matched_windows`` are the item's windows found by template with consistent slots or word for
    word; ``slots`` are the placeholders in the template windows among these.
    """
    items = written(item_windows(benchmark, item_id, item_text), "items")
    every = written(matches(docs, items, doc_id, text, coverage), "matches")
    found = every.filter("__our_template and __their_template")

    pairs = F.arrays_zip(F.col("__window").alias("kind"), F.col("__theirs").alias("theirs"), F.col("__ours").alias("ours"))
    slots = found.select("doc_id", "item_id", "__line", "__at", F.posexplode(pairs).alias("k", "pair")).filter("pair.kind like '<%'")
    line, pair = ["doc_id", "item_id", "__line"], ["doc_id", "item_id"]
    spots = slots.select(*line, "__at", "k", F.col("pair.kind").alias("__kind"), F.col("pair.theirs").alias("__value"), F.col("pair.ours").alias("__own"))
    value = [*line, "__kind", "__value"]
    breaking = spots.groupBy(*value).agg(F.min("__own").alias("low"), F.max("__own").alias("high")).filter("low <> high").select(*value)
    failed = written(_null_safe(spots, breaking, value, "left_semi").select(*line, "__at").distinct(), "failed")
    spot = F.struct("__line", F.col("__at") + F.col("k"))
    filled = _null_safe(spots, failed, [*line, "__at"], "left_anti").groupBy(*pair).agg(
        F.countDistinct(spot).alias("slots"),
        F.countDistinct(F.when(F.col("__own") != F.col("__value"), spot)).alias("changed_slots"),
    )
    plain = every.filter("not (__our_template and __their_template)")
    sound = _null_safe(found, failed, [*line, "__at"], "left_anti").unionByName(plain)
    links = sound.groupBy(*pair).agg(F.countDistinct("__at").alias("matched_windows"))
    totals = items.groupBy("item_id").agg(F.countDistinct("__at").alias("item_windows"))
    counted = _null_safe(_null_safe(links, totals, ["item_id"], "inner"), filled, pair, "left")
    return counted.filter(F.col("matched_windows") >= coverage * F.col("item_windows")).select(
        *pair,
        "matched_windows",
        "item_windows",
        F.coalesce("slots", F.lit(0).cast("bigint")).alias("slots"),
        F.coalesce("changed_slots", F.lit(0).cast("bigint")).alias("changed_slots"),
    )


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join in which a null key equals a null key; the right side's keys are dropped."""
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = [left[k].eqNullSafe(right[f"__r_{k}"]) for k in keys]
    return left.join(right, same, how).drop(*[f"__r_{k}" for k in keys])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are linked to no benchmark item.

    Each text is judged by itself, under its digest: rows that share an id, or have none, do not answer for each other.
    """
    own, at = own_names(docs)
    name = F.unhex(F.sha2(F.coalesce(at["text"], F.lit("")), 256))
    texts = own.select(name.alias("doc_id"), F.col(at["text"]).alias("text"))
    leaked = written(contaminated(texts, benchmark).select(F.col("doc_id").alias("leaked")).distinct(), "leaked")
    kept = own.withColumn("name", name).join(leaked.hint("merge"), F.col("name") == F.col("leaked"), "left_anti")
    return kept.select(*own.columns).toDF(*docs.columns)


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(read(spark, folder, "documents", "doc_id", "text"), read(spark, folder, "benchmark", "item_id", "text"))


_TOKENS = r"""list_filter(string_split_regex(
  regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(coalesce(text, ''),
    '([^.!?:;\x09-\x0D\x20][\x09-\x0D\x20]+)(\p{Lu}\p{Ll})', '\1' || chr(57344) || '\2', 'g'),
    '([0-9])[.,]([0-9])', '\1' || chr(57345) || '\2', 'g')),
    '([0-9])(\p{L})', '\1 \2', 'g'),
    '(UNSPACED)', ' \1 ', 'g'),
  '[^\p{L}\p{N}' || chr(57344) || chr(57345) || ']+'), lambda x: x <> '')""".replace("UNSPACED", UNSPACED)

SQL = f"""
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, {_TOKENS} AS w FROM documents
  UNION ALL SELECT 'i', item_id, {_TOKENS} FROM benchmark
), c AS (
  SELECT side, id, w, list_transform(w, lambda x: ltrim(x, chr(57344))) AS p, list_transform(range(1, len(w) + 1), lambda i: CASE
    WHEN w[i] >= '0' AND w[i] < ':' THEN '<num>'
    WHEN starts_with(w[i], chr(57344)) THEN '<name>'
    WHEN w[i] IN ({", ".join(f"'{u}'" for u in UNITS)}) AND i > 1 AND w[i - 1] >= '0' AND w[i - 1] < ':' THEN '<unit>'
    ELSE w[i] END) AS t
  FROM t
), s AS (
  SELECT side, id, unnest(range(1, len(w) - {WINDOW - 2})) AS pos, w, p, t FROM c WHERE len(w) >= {WINDOW}
), v AS (
  SELECT side, id, pos, w[pos : pos + {WINDOW - 1}] AS w, p[pos : pos + {WINDOW - 1}] AS p, t[pos : pos + {WINDOW - 1}] AS t FROM s
), i AS (
  SELECT id AS item_id, pos, w, p, t FROM v
  WHERE side = 'i' AND len(list_filter(t, lambda x: NOT starts_with(x, '<'))) >= {WORDS}
), f AS (
  SELECT v.id AS doc_id, i.item_id, v.pos - i.pos AS line, i.pos, i.t, i.w AS theirs, v.w AS ours
  FROM v JOIN i ON v.t = i.t WHERE v.side = 'd'
), e AS (
  SELECT v.id AS doc_id, i.item_id, i.pos FROM v JOIN i ON v.p = i.p WHERE v.side = 'd'
), x AS (
  SELECT doc_id, item_id, line, pos, t, theirs, ours, unnest(range(1, {WINDOW + 1})) AS k FROM f
), y AS (
  SELECT doc_id, item_id, line, pos, pos + k AS spot, t[k] AS kind, theirs[k] AS theirs, ours[k] AS ours FROM x WHERE starts_with(t[k], '<')
), b AS (
  SELECT doc_id, item_id, line, kind, theirs FROM y GROUP BY ALL HAVING count(DISTINCT ours) > 1
), z AS (
  SELECT DISTINCT doc_id, item_id, line, pos FROM y SEMI JOIN b USING (doc_id, item_id, line, kind, theirs)
), l AS (
  SELECT doc_id, item_id, count(DISTINCT pos) AS matched_windows FROM (
    SELECT doc_id, item_id, pos FROM f ANTI JOIN z USING (doc_id, item_id, line, pos) UNION ALL SELECT doc_id, item_id, pos FROM e) GROUP BY ALL
), g AS (
  SELECT doc_id, item_id, count(DISTINCT (line, spot)) AS slots,
         count(DISTINCT (line, spot)) FILTER (WHERE ours <> theirs) AS changed_slots
  FROM y ANTI JOIN z USING (doc_id, item_id, line, pos) GROUP BY ALL
), n AS (SELECT item_id, count(DISTINCT pos) AS item_windows FROM i GROUP BY ALL)
SELECT doc_id, item_id, matched_windows, item_windows, coalesce(slots, 0) AS slots, coalesce(changed_slots, 0) AS changed_slots
FROM l JOIN n USING (item_id) LEFT JOIN g USING (doc_id, item_id)
WHERE matched_windows >= {COVERAGE} * item_windows
"""
