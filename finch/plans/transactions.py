"""Transaction queries (categorisation flow) and the monthly/category reports.

Fixture (built from the given tables, so work grows with them):
transactions = lineitem joined with part; Date from l_shipdate (every 97th
order gets an unparsable date), Description = state token + part name, brand
and type, Amount = extended price as text with two decimals. Model responses
are built per batch and attempt from those rows with a category list, with
malformed variants injected by (batch, attempt); every 7th batch never gets a
well-formed answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.constants import BATCH_INSTRUCTION, BATCH_INSTRUCTION_SRC, CATEGORY_RULES, STATE_CODES
from ..operators import reports as rp
from ..operators.ordering import dense_index
from ..operators import retry as rt
from ..operators import transactions as tr
from ..session import scratch_path
from ..sinks.files import write_csv
from ..sources.files import read_transactions_csv
from .common import load

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
         "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
STATE_TOKENS = ["CA", "ny", "Tx", "WA", "Ohio", "DC", "in", "N-J", "#12", ""]
RESP_CATEGORIES = ["Food", "Dining", "Clothing", "Health", "Transport", "Rent", "Groceries",
                   "Entertainment", "Online Shopping", "Travel", "Home and Garden Supplies", "Utilities"]
EVENT_CATEGORIES = [
    "Food Delivery", "Retail/Dining", "Retail/Fast Food", "Entertainment (Food)", "Fine Dining",
    "Asian Cuisine", "Restaurant", "Mexican", "Beverages", "Eating Out", "Drinks", "Coffee",
    "Clothing", "Sport Clothing", "Business Services", "Wellness", "Health Care", "Sports", "Fitness",
    "Travel", "Online Travel", "Accommodation", "Airline", "Airplane Tickets", "Transport",
    "Transportation", "Housing", "Rent", "Car Rental", "Groceries", "Grocery", "Recreation",
    "Entertainment", "Telephone", "Telecommunication", "communication", "Online Payment", "Online",
    "Retail", "Shopping", "Miscellaneous", "Category", "Utilities", "Insurance", "Education",
    "Charity", "Communications", None,
]
HEADER = "Here are the categories:"
FOOTER = "Hope this helps!"
BAD_LINE = "Sorry, I cannot categorize this one"
FIVE_FIELDS = "A - B - C - D - E"


# ---------------------------------------------------------------------------
# fixtures
# ---------------------------------------------------------------------------

def transactions(spark: SparkSession, d: str, numbered: bool = False) -> DataFrame:
    """Transactions; with ``numbered`` each row carries ``idx``, its position in
    ORDER. Rows are numbered on the narrow lineitem scan, before the join and
    the text work, so the range sort never re-runs them."""
    li = load(spark, d, "lineitem", ORDER)
    if numbered:
        li = dense_index(li, ORDER, "idx")
    part = load(spark, d, "part", ["p_partkey", "p_name", "p_brand", "p_type"])
    j = li.join(part, li.l_partkey == part.p_partkey, "left")   # keeps every row, so numbering first is exact
    state = F.element_at(F.array(*[F.lit(s) for s in STATE_TOKENS]),
                         (F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.lit(len(STATE_TOKENS))) + 1).cast("int"))
    date = F.when(F.pmod("l_orderkey", F.lit(97)) == 0, F.lit("n/a")).otherwise(F.date_format("l_shipdate", "MM/dd/yyyy"))
    return j.select(*ORDER, *(["idx"] if numbered else []), date.alias("Date"),
                    F.concat_ws(" ", state, "p_name", "p_brand", "p_type").alias("Description"),
                    F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("Amount"))


def cleaned(spark, d):
    return tr.clean_descriptions(transactions(spark, d))


def batched(spark, d, drop_last=False):
    rows = tr.key_strings(tr.clean_descriptions(transactions(spark, d, numbered=True)))
    return tr.assign_batches(rows, ORDER, drop_last=drop_last, index_col="idx")


def responses(spark: SparkSession, d: str) -> DataFrame:
    """(batch_id, attempt, response) for attempts 1..5 of every sent batch."""
    return answers_to(batched(spark, d))


def answers_to(sent: DataFrame) -> DataFrame:
    cats = F.array(*[F.lit(c) for c in RESP_CATEGORIES])
    rows = sent.withColumn(
        "rl", F.concat_ws(" - ", "line", F.element_at(cats, (F.pmod("idx", F.lit(len(RESP_CATEGORIES))) + 1).cast("int"))))
    body = rows.groupBy("batch_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("idx", "rl"))), lambda r: r["rl"]), "\n").alias("body"))
    att = body.select("batch_id", "body", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("attempt"))
    # every 7th batch only ever gets malformed answers (it ends in the reject table)
    bad_only = F.element_at(F.array(F.lit(0), F.lit(1), F.lit(4)), (F.pmod("attempt", F.lit(3)) + 1).cast("int"))
    f = F.when(F.pmod("batch_id", F.lit(7)) == 0, bad_only).otherwise(F.pmod(F.col("batch_id") * 3 + F.col("attempt"), F.lit(5)))
    b = F.col("body")
    resp = (F.when(f == 0, F.concat(F.lit(HEADER + "\n"), b))
             .when(f == 1, F.concat(F.lit(HEADER + "\n\n"), b, F.lit(f"\n{BAD_LINE}\n\n{FOOTER}")))
             .when(f == 2, F.concat(F.lit(HEADER + "\n\n"), b))
             .when(f == 3, F.concat(F.lit(HEADER + "\n\n"), b, F.lit(f"\n\n{FOOTER}")))
             .otherwise(F.concat(F.lit(HEADER + "\n\n"), b, F.lit(f"\n{FIVE_FIELDS}\n\n{FOOTER}"))))
    return att.select("batch_id", "attempt", resp.alias("response"))


def event_categories(spark: SparkSession, d: str) -> DataFrame:
    cats = F.array(*[F.lit(c) for c in EVENT_CATEGORIES])
    ev = load(spark, d, "events", ["event_id", "ts"])
    return ev.select("event_id", F.date_format("ts", "MM/dd/yyyy").alias("Date"),
                     F.element_at(cats, (F.pmod("event_id", F.lit(len(EVENT_CATEGORIES))) + 1).cast("int")).alias("Category"))


def first_valid_rows(spark, d):
    return tr.first_valid(tr.batch_valid(tr.response_block(responses(spark, d))))


# ---------------------------------------------------------------------------
# queries
# ---------------------------------------------------------------------------

def txn_clean_description(spark, d):
    t = transactions(spark, d).withColumn("raw", F.col("Description"))
    return tr.clean_descriptions(t).select("l_orderkey", "l_linenumber", "raw", "Description")


def txn_key_string(spark, d):
    return tr.key_strings(cleaned(spark, d)).select("l_orderkey", "l_linenumber", "line")


def txn_batches(spark, d):
    return batched(spark, d).select("idx", "batch_id", "line")


def txn_batches_drop_last(spark, d):
    """T5 as one notebook's loop has it: the last batch is never sent."""
    return batched(spark, d, drop_last=True).select("idx", "batch_id", "line")


def txn_batch_prompts(spark, d):
    return tr.batch_prompts(batched(spark, d))


def txn_batch_prompts_src(spark, d):
    """T6 module form: instruction + rows joined by newlines. The original
    sends every row in one prompt; here the same text is built per batch, so
    no single group ever holds the whole table."""
    return tr.batch_prompts(batched(spark, d), sep="\n", instruction=BATCH_INSTRUCTION_SRC)


def resp_parse_lines(spark, d):
    return tr.parse_response_lines(responses(spark, d))


def resp_validate(spark, d):
    return tr.validate_categories(tr.parse_response_lines(responses(spark, d)))


def resp_block(spark, d):
    blk = tr.response_block(responses(spark, d))
    return blk.select("batch_id", "attempt", F.posexplode("block").alias("line_no", "line"))


def resp_batch_valid(spark, d):
    return tr.batch_valid(tr.response_block(responses(spark, d))).select("batch_id", "attempt", "valid")


def resp_first_valid(spark, d):
    return first_valid_rows(spark, d)


def resp_retry(spark, d):
    """T11 as a loop: each attempt asks only for the batches without a valid answer
    (here a look-up of that attempt's answers stands for the model)."""
    path = scratch_path(spark, "retry")
    sent = batched(spark, d)                # numbered once, for the prompts and the answers
    answers_to(sent).write.parquet(f"{path}/model")
    model = spark.read.parquet(f"{path}/model")
    prompts = tr.batch_prompts(sent)
    return rt.categorise_retry(prompts, path, lambda pending, attempt: model.where(F.col("attempt") == attempt).join(
        pending.select("batch_id"), "batch_id", "left_semi").select("batch_id", "response"))


def resp_rejected(spark, d):
    """T11 reject table: batches without a valid attempt in four tries."""
    return tr.rejected_batches(tr.batch_valid(tr.response_block(responses(spark, d))))


def txn_union(spark, d):
    """Batch results appended; both parse paths, tagged."""
    answers = responses(spark, d)          # numbered once, used by both paths
    nb = tr.first_valid(tr.batch_valid(tr.response_block(answers))).select(F.lit("notebook").alias("path"), "batch_id", "attempt", "line_no",
                                           "Date", "Description", "Amount", "Category")
    src = tr.validate_categories(tr.parse_response_lines(answers)).select(
        F.lit("module").alias("path"), "batch_id", "attempt", "line_no",
        F.col("date").alias("Date"), F.col("description").alias("Description"),
        F.col("amount").alias("Amount"), F.col("category").alias("Category"))
    return nb.unionByName(src)


def txn_join_category(spark, d):
    cats = first_valid_rows(spark, d).select("Date", "Description", "Amount", "Category")
    return tr.join_categories(cleaned(spark, d), cats).select(
        "l_orderkey", "l_linenumber", "Date", "Description", "Amount", "Category")


def txn_head(spark, d):
    return cleaned(spark, d).orderBy(*ORDER).limit(5).select("Date", "Description", "Amount")


def category_canonical(spark, d):
    return tr.canonical_categories(event_categories(spark, d)).select(
        "event_id", F.col("Category").alias("Category"))


def category_distinct(spark, d):
    return category_canonical(spark, d).select("Category").distinct()


def date_coerce(spark, d):
    t = transactions(spark, d)
    return t.select("l_orderkey", "l_linenumber", "Date",
                    F.date_format(rp.coerce_date("Date"), "yyyy-MM-dd").alias("parsed"))


def txn_month_year(spark, d):
    return rp.with_month_year(transactions(spark, d)).select("l_orderkey", "l_linenumber", "Month", "Year")


def txn_per_month(spark, d):
    o = load(spark, d, "orders", ["o_orderdate"])
    return rp.count_per(rp.with_month_year(o, "o_orderdate"), "Month")


def txn_per_category(spark, d):
    return rp.count_per(category_canonical(spark, d), "Category")


def txn_category_share(spark, d):
    return rp.share_of_total(txn_per_category(spark, d)).withColumn("Percent", F.round("Percent", 6))


def scan_csv(spark, d):
    """Transactions as a card export has them (another column order, a
    further column, quotes and line breaks), read back by header."""
    path = scratch_path(spark, "txn-csv")
    write_csv(csv_export(transactions(spark, d)).select("Amount", "Card Member", "Description", "Date"), path)
    return read_transactions_csv(spark, path, multi_line=True)


def csv_export(txn: DataFrame) -> DataFrame:
    noisy = F.when(F.pmod("l_orderkey", F.lit(5)) == 0, F.concat(F.lit('say "hi", '), "Description", F.lit("\nsecond line"))).otherwise(F.col("Description"))
    return txn.select("Date", noisy.alias("Description"), "Amount", F.concat(F.lit("Holder "), F.pmod("l_orderkey", F.lit(7)).cast("string")).alias("Card Member"))


def sink_csv_roundtrip(spark, d):
    """K1: categorised transactions to CSV and back."""
    path = scratch_path(spark, "categorized-csv")
    write_csv(first_valid_rows(spark, d).select("Date", "Description", "Amount", "Category"), path)
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("Date", "Description", "Amount", "Category")])
    return read_transactions_csv(spark, path, schema, multi_line=True)


QUERIES = {
    "txn_clean_description": txn_clean_description,
    "txn_key_string": txn_key_string,
    "txn_batches": txn_batches,
    "txn_batches_drop_last": txn_batches_drop_last,
    "txn_batch_prompts": txn_batch_prompts,
    "txn_batch_prompts_src": txn_batch_prompts_src,
    "resp_parse_lines": resp_parse_lines,
    "resp_validate": resp_validate,
    "resp_block": resp_block,
    "resp_batch_valid": resp_batch_valid,
    "resp_first_valid": resp_first_valid,
    "resp_retry": resp_retry,
    "resp_rejected": resp_rejected,
    "txn_union": txn_union,
    "txn_join_category": txn_join_category,
    "txn_head": txn_head,
    "category_canonical": category_canonical,
    "category_distinct": category_distinct,
    "date_coerce": date_coerce,
    "txn_month_year": txn_month_year,
    "txn_per_month": txn_per_month,
    "txn_per_category": txn_per_category,
    "txn_category_share": txn_category_share,
    "scan_csv": scan_csv,
    "sink_csv_roundtrip": sink_csv_roundtrip,
}

# ---------------------------------------------------------------------------
# DuckDB oracle SQL
# ---------------------------------------------------------------------------


def _lit(s):
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _list(xs):
    return "[" + ", ".join(_lit(x) for x in xs) + "]"


_ORDER = ", ".join(ORDER)
_PY_WS = r"[\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STATES = "|".join(STATE_CODES)

_TXN = f"""
txn AS (
  SELECT {_ORDER},
    CASE WHEN l_orderkey % 97 = 0 THEN 'n/a' ELSE strftime(l_shipdate, '%m/%d/%Y') END AS Date,
    concat_ws(' ', {_list(STATE_TOKENS)}[(l_orderkey * 7 + l_linenumber) % {len(STATE_TOKENS)} + 1], p_name, p_brand, p_type) AS Description,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS Amount
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
clean AS (
  SELECT * EXCLUDE (Description), Description AS raw,
    trim(replace(regexp_replace(array_to_string(list_slice(list_filter(string_split(
      regexp_replace(regexp_replace(lower(Description), '{_PY_WS}+', ' ', 'g'), '[^a-z ]', '', 'g'), ' '),
      lambda w: w <> ''), 1, 3), ' '), '\\b(?:{_STATES})\\b', '', 'g'), '-', ' ')) AS Description
  FROM txn),
keyed AS (SELECT *, concat_ws(' - ', coalesce(Date, 'nan'), coalesce(Description, 'nan'), coalesce(Amount, 'nan')) AS line FROM clean),
numbered AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 AS idx FROM keyed),
batched AS (SELECT *, CAST(floor(idx / 10) AS BIGINT) AS batch_id FROM numbered)"""

_RESP = f"""{_TXN},
rl AS (SELECT batch_id, idx, concat_ws(' - ', line, {_list(RESP_CATEGORIES)}[idx % {len(RESP_CATEGORIES)} + 1]) AS rl FROM batched),
body AS (SELECT batch_id, string_agg(rl, chr(10) ORDER BY idx) AS body FROM rl GROUP BY batch_id),
att AS (SELECT batch_id, body, unnest(range(1, 6)) AS attempt FROM body),
responses AS (
  SELECT batch_id, CAST(attempt AS INTEGER) AS attempt,
    CASE CASE WHEN batch_id % 7 = 0 THEN [0, 1, 4][attempt % 3 + 1] ELSE (batch_id * 3 + attempt) % 5 END
      WHEN 0 THEN {_lit(HEADER)} || chr(10) || body
      WHEN 1 THEN {_lit(HEADER)} || chr(10) || chr(10) || body || chr(10) || {_lit(BAD_LINE)} || chr(10) || chr(10) || {_lit(FOOTER)}
      WHEN 2 THEN {_lit(HEADER)} || chr(10) || chr(10) || body
      WHEN 3 THEN {_lit(HEADER)} || chr(10) || chr(10) || body || chr(10) || chr(10) || {_lit(FOOTER)}
      ELSE {_lit(HEADER)} || chr(10) || chr(10) || body || chr(10) || {_lit(FIVE_FIELDS)} || chr(10) || chr(10) || {_lit(FOOTER)}
    END AS response
  FROM att),
parsed AS (
  SELECT batch_id, attempt, CAST(line_no - 1 AS INTEGER) AS line_no, p[1] AS date, p[2] AS description, p[3] AS amount, p[4] AS category
  FROM (SELECT batch_id, attempt, line_no, string_split(line, ' - ') AS p FROM (
        SELECT batch_id, attempt, unnest(l) AS line, generate_subscripts(l, 1) AS line_no
        FROM (SELECT batch_id, attempt, string_split(response, chr(10)) AS l FROM responses)))
  WHERE len(p) = 4),
validated AS (SELECT * FROM parsed WHERE len(list_filter(regexp_split_to_array(category, '{_PY_WS}+'), lambda w: w <> '')) <= 3),
blocks AS (
  SELECT batch_id, attempt,
    CASE WHEN len(bl) = 0 THEN NULL
         WHEN len(bl) = 1 THEN list_slice(l, bl[1] + 1, len(l))
         ELSE list_slice(l, bl[1] + 1, bl[2] - 1) END AS block
  FROM (SELECT batch_id, attempt, l,
          list_filter(list_transform(l, lambda x, i: CASE WHEN x = '' THEN i ELSE -1 END), lambda i: i >= 0) AS bl
        FROM (SELECT batch_id, attempt, string_split(response, chr(10)) AS l FROM responses))),
checked AS (
  SELECT batch_id, attempt, block,
    coalesce(block IS NOT NULL
      AND len(list_filter(block, lambda x: NOT (x = '' OR contains(x, '-')))) = 0
      AND len(list_filter(block, lambda x: len(string_split(x, ' - ')) <> 4)) = 0, false) AS valid
  FROM blocks),
firsts AS (SELECT batch_id, min(attempt) AS attempt FROM checked WHERE valid AND attempt <= 4 GROUP BY batch_id),
fv AS (
  SELECT batch_id, attempt, CAST(line_no - 1 AS INTEGER) AS line_no, p[1] AS Date, p[2] AS Description, p[3] AS Amount, p[4] AS Category
  FROM (SELECT batch_id, attempt, line_no, string_split(line, ' - ') AS p FROM (
        SELECT c.batch_id, c.attempt, unnest(c.block) AS line, generate_subscripts(c.block, 1) AS line_no
        FROM checked c JOIN firsts f ON c.batch_id = f.batch_id AND c.attempt = f.attempt)))"""


def _case_rules(col):
    parts = []
    for words, target in CATEGORY_RULES:
        cond = " OR ".join(f"contains({col}, {_lit(w)})" for w in words)
        parts.append(f"WHEN {cond} THEN {_lit(target)}")
    return "CASE " + " ".join(parts) + f" ELSE {col} END"


_EVENTS = f"""
ev AS (SELECT event_id, strftime(ts, '%m/%d/%Y') AS Date,
              {_list(EVENT_CATEGORIES)}[event_id % {len(EVENT_CATEGORIES)} + 1] AS Category FROM events),
canon AS (SELECT event_id, {_case_rules('Category')} AS Category FROM ev WHERE Date IS NOT NULL AND Category IS NOT NULL)"""

_DATES = "coalesce(try_strptime(Date, '%m/%d/%Y'), try_strptime(Date, '%Y-%m-%d'))"

ORACLE = {
    "txn_clean_description": f"WITH {_TXN} SELECT l_orderkey, l_linenumber, raw, Description FROM clean",
    "txn_key_string": f"WITH {_TXN} SELECT l_orderkey, l_linenumber, line FROM keyed",
    "txn_batches": f"WITH {_TXN} SELECT idx, batch_id, line FROM batched",
    "txn_batches_drop_last": f"WITH {_TXN} SELECT idx, batch_id, line FROM batched WHERE batch_id < (SELECT max(batch_id) FROM batched)",
    "txn_batch_prompts": (f"WITH {_TXN} SELECT batch_id, {_lit(BATCH_INSTRUCTION)} || string_agg(line, ',' ORDER BY idx) "
                          f"AS prompt FROM batched GROUP BY batch_id"),
    "txn_batch_prompts_src": (f"WITH {_TXN} SELECT batch_id, {_lit(BATCH_INSTRUCTION_SRC)} || "
                              f"string_agg(line, chr(10) ORDER BY idx) AS prompt FROM batched GROUP BY batch_id"),
    "resp_parse_lines": f"WITH {_RESP} SELECT * FROM parsed",
    "resp_validate": f"WITH {_RESP} SELECT * FROM validated",
    "resp_block": (f"WITH {_RESP} SELECT batch_id, attempt, CAST(line_no - 1 AS INTEGER) AS line_no, line FROM ("
                   f"SELECT batch_id, attempt, unnest(block) AS line, generate_subscripts(block, 1) AS line_no "
                   f"FROM blocks WHERE block IS NOT NULL)"),
    "resp_batch_valid": f"WITH {_RESP} SELECT batch_id, attempt, valid FROM checked",
    "resp_first_valid": f"WITH {_RESP} SELECT * FROM fv",
    "resp_retry": f"WITH {_RESP} SELECT * FROM fv",
    "resp_rejected": (f"WITH {_RESP} SELECT batch_id, count(*) AS attempts FROM checked WHERE attempt <= 4 "
                      f"GROUP BY batch_id HAVING max(CAST(valid AS INTEGER)) = 0"),
    "txn_union": (f"WITH {_RESP} SELECT 'notebook' AS path, batch_id, attempt, line_no, Date, Description, Amount, Category FROM fv "
                  f"UNION ALL SELECT 'module', batch_id, attempt, line_no, date, description, amount, category FROM validated"),
    "txn_join_category": (f"WITH {_RESP} SELECT c.l_orderkey, c.l_linenumber, c.Date, c.Description, c.Amount, f.Category "
                          f"FROM clean c LEFT JOIN fv f ON c.Date IS NOT DISTINCT FROM f.Date "
                          f"AND c.Description IS NOT DISTINCT FROM f.Description AND c.Amount IS NOT DISTINCT FROM f.Amount"),
    "txn_head": f"WITH {_TXN} SELECT Date, Description, Amount FROM clean ORDER BY {_ORDER} LIMIT 5",
    "category_canonical": f"WITH {_EVENTS} SELECT event_id, Category FROM canon",
    "category_distinct": f"WITH {_EVENTS} SELECT DISTINCT Category FROM canon",
    "date_coerce": f"WITH {_TXN} SELECT l_orderkey, l_linenumber, Date, strftime({_DATES}, '%Y-%m-%d') AS parsed FROM txn",
    "txn_month_year": (f"WITH {_TXN} SELECT l_orderkey, l_linenumber, CAST(month({_DATES}) AS INTEGER) AS Month, "
                       f"CAST(year({_DATES}) AS INTEGER) AS Year FROM txn"),
    "txn_per_month": ("SELECT CAST(month(o_orderdate) AS INTEGER) AS Month, count(*) AS Count FROM orders "
                      "WHERE o_orderdate IS NOT NULL GROUP BY 1"),
    "txn_per_category": f"WITH {_EVENTS} SELECT Category, count(*) AS Count FROM canon GROUP BY Category",
    "txn_category_share": (f"WITH {_EVENTS}, c AS (SELECT Category, count(*) AS Count FROM canon GROUP BY Category) "
                           f"SELECT Category, Count, round(100.0 * Count / sum(Count) OVER (), 6) AS Percent FROM c"),
    "scan_csv": (f"WITH {_TXN} SELECT Date, CASE WHEN l_orderkey % 5 = 0 THEN 'say \"hi\", ' || Description || chr(10) || 'second line' "
                 f"ELSE Description END AS Description, Amount, 'Holder ' || CAST(l_orderkey % 7 AS VARCHAR) AS \"Card Member\" FROM txn"),
    "sink_csv_roundtrip": f"WITH {_RESP} SELECT Date, Description, Amount, Category FROM fv",
}
