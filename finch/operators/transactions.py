"""Transaction operators: cleaning, row keys, batches, prompt batches, model
response parsing and validation, first valid attempt, category join and
canonical categories. Everything is column expressions, equi-joins and small
groups (a batch holds at most ``BATCH_SIZE`` rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.constants import BATCH_INSTRUCTION, BATCH_SIZE, FIELD_SEP, MAX_ATTEMPTS
from ..functions.transactions import canonical_category, category_is_short, clean_description, row_key
from .ordering import dense_index

TXN_COLS = ("Date", "Description", "Amount")


def require_column(df: DataFrame | None, column: str) -> None:
    """Fail like the original when no frame is loaded or the column is missing."""
    if df is None or column not in df.columns:
        raise ValueError(f"DataFrame is None or column {column} not found.")


def clean_descriptions(df: DataFrame, column: str = "Description", faithful_nulls: bool = False) -> DataFrame:
    require_column(df, column)
    return df.withColumn(column, clean_description(column, faithful_nulls=faithful_nulls))


def key_strings(df: DataFrame, cols=TXN_COLS, out_col: str = "line") -> DataFrame:
    """``"Date - Description - Amount"`` per row."""
    return df.withColumn(out_col, row_key(*cols))


def assign_batches(df: DataFrame, order_cols: list, size: int = BATCH_SIZE,
                   drop_last: bool = False, index_col: str | None = None) -> DataFrame:
    """Position (``idx``) and batch (``batch_id`` = idx div size) in row order.
    ``drop_last=True`` reproduces the original loop, which never sends the
    last batch. ``index_col`` names an existing position column (numbered
    earlier, e.g. on the narrow source table before joins), so no second sort."""
    numbered = df.withColumnRenamed(index_col, "idx") if index_col else dense_index(df, order_cols, "idx")
    out = numbered.withColumn("batch_id", F.floor(F.col("idx") / size))
    if drop_last:
        out = out.where(F.col("batch_id") < out.select(F.max("batch_id")).scalar())
    return out


def batch_prompts(batched: DataFrame, line_col: str = "line", sep: str = ",",
                  instruction: str = BATCH_INSTRUCTION) -> DataFrame:
    """One prompt per batch: instruction + the batch's rows in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("idx"), F.col(line_col).alias("l"))))
    return batched.groupBy("batch_id").agg(
        F.concat(F.lit(instruction), F.array_join(F.transform(rows, lambda r: r["l"]), sep)).alias("prompt"))


def _field_count(line) -> Column:
    """How many fields " - " cuts a line into, without cutting it."""
    return ((F.char_length(line) - F.char_length(F.replace(line, F.lit(FIELD_SEP), F.lit("")))) / len(FIELD_SEP)).cast("int") + 1


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a column that is worked out once a row, however often later
    expressions and filters name it (a plain column is put in the place of each of its uses)."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def _fields(lines: DataFrame) -> tuple[DataFrame, list]:
    """The rows with their ``line`` cut, and its first four fields."""
    cut = _once(lines, "_f", F.split("line", FIELD_SEP))
    return cut, [F.col("_f").getItem(i) for i in range(4)]


def parse_response_lines(responses: DataFrame, resp_col: str = "response",
                         keys=("batch_id", "attempt")) -> DataFrame:
    """Module form: every response line that splits into exactly four fields
    on " - " becomes a row (date, description, amount, category)."""
    lines = responses.select(*keys, F.posexplode(F.split(resp_col, "\n")).alias("line_no", "line"))
    whole, (d, desc, amt, cat) = _fields(lines.where(_field_count(F.col("line")) == 4))
    return whole.select(*keys, "line_no", d.alias("date"), desc.alias("description"),
                        amt.alias("amount"), cat.alias("category"))


def validate_categories(parsed: DataFrame, column: str = "category", max_words: int = 3) -> DataFrame:
    """Rows whose category has more than ``max_words`` words are skipped."""
    return parsed.where(category_is_short(column, max_words))


def response_block(responses: DataFrame, resp_col: str = "response") -> DataFrame:
    """Notebook form: the lines between the first two empty lines (after the
    only one, if there is one); NULL when the response has no empty line."""
    def between(lines):
        at = F.array_position(lines, "")
        rest = F.slice(lines, (at + 1).cast("int"), F.size(lines))

        def cut(rest):
            stop = F.array_position(rest, "")
            return F.when(stop == 0, rest).otherwise(F.slice(rest, 1, (stop - 1).cast("int")))
        return F.when(at > 0, F.transform(F.array(rest), cut)[0])
    return _once(responses, "block", F.transform(F.array(F.split(resp_col, "\n")), between)[0])


def batch_valid(blocks: DataFrame) -> DataFrame:
    """All-or-nothing check of a block: every non-empty line has a hyphen and
    every line splits into exactly four fields (which takes three hyphens, so it is
    the one thing to look at)."""
    ok = F.forall("block", lambda l: _field_count(l) == 4)
    return blocks.withColumn("valid", F.coalesce(ok, F.lit(False)))


def first_valid(checked: DataFrame, max_attempts: int = MAX_ATTEMPTS,
                keys=("batch_id",)) -> DataFrame:
    """Rows of the first valid attempt per batch (attempts 1..max_attempts);
    a batch with no valid attempt is dropped, as in the original."""
    ok = checked.where(F.col("valid") & (F.col("attempt") <= max_attempts))
    # the first of a batch's few attempts is cut out before the shuffle (WindowGroupLimit)
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("attempt"))
    chosen = ok.select(*keys, "attempt", "block").withColumn("_turn", turn).where("_turn = 1")
    rows = chosen.select(*keys, "attempt", F.posexplode("block").alias("line_no", "line"))
    cut, (d, desc, amt, cat) = _fields(rows)
    return cut.select(*keys, "attempt", "line_no", d.alias("Date"), desc.alias("Description"),
                       amt.alias("Amount"), cat.alias("Category"))


def rejected_batches(checked: DataFrame, max_attempts: int = MAX_ATTEMPTS, keys=("batch_id",)) -> DataFrame:
    """Batches with no valid attempt among the first ``max_attempts`` (the
    original drops them silently; here they are kept as a reject table)."""
    within = checked.where(F.col("attempt") <= max_attempts)
    return (within.groupBy(*keys)
                  .agg(F.count(F.lit(1)).alias("attempts"),
                       F.max(F.col("valid").cast("int")).alias("_any"))
                  .where(F.col("_any") == 0).drop("_any"))


def join_categories(txn: DataFrame, cats: DataFrame, keys=TXN_COLS, dedupe_right: bool = False) -> DataFrame:
    """Left join of categories on the three row fields; missing keys match
    each other (null-safe). As in the original, m equal rows against n equal
    answers give m x n rows: the result itself grows so. ``dedupe_right`` keeps
    one category per key (the smallest) and every left row once; use it where
    rows repeat often."""
    right = cats.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("Category"))
    if dedupe_right:
        right = right.groupBy(*[f"_r_{k}" for k in keys]).agg(F.min("Category").alias("Category"))
    cond = [txn[k].eqNullSafe(right[f"_r_{k}"]) for k in keys]
    return txn.join(right, cond, "left").drop(*[f"_r_{k}" for k in keys])


def canonical_categories(df: DataFrame, column: str = "Category") -> DataFrame:
    """Drop rows with any missing value, then map categories to canonical names."""
    return df.na.drop("any").withColumn(column, canonical_category(column))
