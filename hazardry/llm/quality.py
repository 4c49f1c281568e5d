"""Quality rules as a bitmask ledger.

Every rule is evaluated once over the whole text. The ledger row keeps the measurements and one bit
for each rule that the text fails. A policy is a version, and the mask of the bits that reject; it is
applied to a stored ledger with one bitwise AND, so a new policy needs no new pass over the texts, and
ablations are sums over bits. Built-in functions only; a text never leaves its row, so there is no shuffle
but that of the (tiny) ablation.

Defined results: a null or empty text has no words, hence fails ``few_words``. Repeated rows get a row
each. An empty table gives an empty ledger. Columns of the input other than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardry.llm.common import let, strip_space, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_echo_words")

#: Name and SQL condition of each rule; a rule's bit is its place here. Conditions are whole-number
#: arithmetic over the measurements, so that every engine decides alike. Append only: stored ledgers keep
#: their meaning.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("long_words", "word_chars > 25 * n_words"),
    ("echoed_words", "100 * n_echo_words > 20 * n_words"),
)


def bit(name: str) -> int:
    """The mask of one rule."""
    return 1 << [rule for rule, _ in RULES].index(name)


@dataclass(frozen=True)
class Policy:
    """A version, and the rules whose failure rejects a text."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(bit(name) for name in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
STANDARD = Policy("1", tuple(name for name, _ in RULES))


def _repeated(tokens: Column) -> Column:
    """How many words lie in windows of five words that occur twice or more.

    Only texts with an equal pair of window hashes are looked at closely: there hashes and places are sorted together, and neighbours compared.
    """
    # item by item: slice() would copy the whole array for each window
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(tokens) - F.lit(WINDOW)), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(WINDOW)])
    )

    def covered(found: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda p: F.sequence(p, p + F.lit(WINDOW - 1))))))

    def close(h: Column) -> Column:
        def doubled(rows: Column) -> Column:
            def same(x: Column, i: Column) -> Column:
                near = [F.coalesce(F.get(rows, i + k)["h"] == x["h"], F.lit(False)) for k in (-1, 1)]
                return near[0] | near[1]

            return covered(F.transform(F.filter(rows, same), lambda x: x["i"]))

        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), doubled)

    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(close(h)))
    return F.when(F.size(tokens) < WINDOW, F.lit(0)).otherwise(counted)


def ledger_column(text: Column) -> Column:
    """Struct of the measurements and ``fail_bits`` of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: strip_space(x) != "")
    taken = let(
        words(text),
        lambda tokens: F.struct(
            F.size(tokens).alias("n_words"),
            F.length(F.array_join(tokens, "")).alias("word_chars"),
            _repeated(tokens).alias("n_repeat_words"),
            F.size(F.filter(tokens, lambda x, i: F.coalesce(F.get(tokens, i - 1) == x, F.lit(False)))).alias("n_echo_words"),
        ),
    )

    def measured(both: Column) -> Column:
        token, line = both["w"], both["l"]
        return F.struct(
            token["n_words"].cast("long").alias("n_words"),
            token["word_chars"].cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
            F.size(line).cast("long").alias("n_lines"),
            (F.size(line) - F.size(F.array_distinct(line))).cast("long").alias("n_dup_lines"),
            token["n_repeat_words"].cast("long").alias("n_repeat_words"),
            token["n_echo_words"].cast("long").alias("n_echo_words"),
        )

    return let(F.struct(taken.alias("w"), lines.alias("l")), measured)


def fail_bits() -> Column:
    """The bits of the rules that fail, from measurement columns."""
    found = F.lit(0).cast("long")
    for place, (_, condition) in enumerate(RULES):
        found = found.bitwiseOR(F.when(F.expr(condition), F.lit(1 << place)).otherwise(F.lit(0)).cast("long"))
    return found


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measure every text once: id, the measurements and ``fail_bits``."""
    return (
        df.select(F.col(id_col), ledger_column(F.col(text_col)).alias("_hz_m"))
        .select(id_col, *[F.col("_hz_m")[name].alias(name) for name in MEASURES])
        .withColumn("fail_bits", fail_bits())
    )


def fails(policy: Policy) -> Column:
    """Whether a ledger row fails a rule of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with the policy's version and verdict."""
    return rows.withColumn("policy", F.lit(policy.version)).withColumn("kept", ~fails(policy))


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: how many texts fail it, and how many only it rejects.

    One pass: the distinct masks (2 to the number of rules at most) are counted first.
    """
    masks = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("m")).count()
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(bit(n)).cast("long").alias("b")) for n in policy.rules])
    each = masks.select("m", "count", F.inline(rules))
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("m").bitwiseAND(F.col("b")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("m") == F.col("b"), F.col("count")).otherwise(0)).alias("n_only"),
    )


def keep_documents(df: DataFrame, policy: Policy = STANDARD, text_col: str = "text") -> DataFrame:
    """The rows whose text passes the policy, with the columns that came in."""
    names = df.columns
    measured = df.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_hz_row"), ledger_column(F.col(text_col)).alias("_hz_m"))
    flat = measured.select("_hz_row", *[F.col("_hz_m")[name].alias(name) for name in MEASURES])
    kept = flat.withColumn("fail_bits", fail_bits()).filter(~fails(policy))
    return kept.select("_hz_row.*")
