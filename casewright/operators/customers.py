"""Customer book: sales, tabs, filters, metrics, sorting and pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from casewright import vocabulary as V
from casewright.functions import text as X
from casewright.sources.tables import small_table
from casewright.sources.working import working_table

SALES = ["mtd_sales", "lm_sales", "ytd_sales", "ly_sales", "ltd_sales"]

# Names, contact and billing columns of a customer, shown as they are where the table has them.
CONTACT = [
    *("first_name", "last_name", "referred_by", "email", "office_phone", "cell", "fax"),
    *("address1", "address2", "zip_code", "country", "bill_contact", "bill_email", "bill_phone"),
    *("bill_address1", "bill_address2", "bill_city", "bill_state", "bill_zip_code", "bill_country"),
]


def customer_book(customers: DataFrame, dates: DataFrame, sales: DataFrame) -> DataFrame:
    """Live customers with a usable id, their case dates and sales; missing sales are zero."""
    live = customers.filter(
        ~F.coalesce("deleted", F.lit(False)) & X.non_blank(F.col("customer_id"))
    )
    book = live.join(sales, "customer_id", "left").join(dates, "customer_id", "left")
    for name in SALES:
        book = book.withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("decimal(18,2)"))
    return book.select(
        "customer_id",
        "practice_name",
        X.full_name(F.col("first_name"), F.col("last_name")).alias("full_name"),
        "sales_person",
        "dental_group",
        "type",
        "specialty",
        "city",
        "state",
        "price_catalog",
        *[name for name in CONTACT if name in customers.columns],
        *SALES,
        "date_of_first_case",
        "date_of_last_case",
        "active",
        "prospect",
    )


def tab_condition(tab: str) -> Column:
    """'active', 'prospects' or everything; a customer that is both is in neither tab."""
    active, prospect = (F.coalesce(F.col(c), F.lit(False)) for c in ("active", "prospect"))
    return {"active": active & ~prospect, "prospects": prospect & ~active}.get(tab, F.lit(True))


def filter_customers(
    book: DataFrame,
    *,
    tab: str = "all",
    filters: Mapping[str, str] | None = None,
    search: str | None = None,
) -> DataFrame:
    """Tab, equality filters and a case-insensitive search over all columns."""
    rows = book.filter(tab_condition(tab))
    for name, value in (filters or {}).items():
        if value:
            rows = rows.filter(F.coalesce(F.col(name).cast("string"), F.lit("")) == value)
    if search and search.strip():
        texts = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in book.columns])
        wanted = search.strip().lower()
        rows = rows.filter(F.exists(texts, lambda t: F.lower(t).contains(wanted)))
    return rows


def customer_metrics(book: DataFrame, *, as_of: date) -> DataFrame:
    """Active, prospects, new this month, new this year and sales of the new ones."""
    first = F.col("date_of_first_case")
    this_year = F.coalesce(F.year(first) == as_of.year, F.lit(False))
    this_month = this_year & (F.month(first) == as_of.month)
    new_sales = F.sum(F.when(this_year, F.col("ytd_sales")).otherwise(F.lit(0).cast("decimal(18,2)")))
    return book.agg(
        F.count_if(tab_condition("active")).alias("active"),
        F.count_if(tab_condition("prospects")).alias("prospects"),
        F.count_if(this_month).alias("new_this_month"),
        F.count_if(this_year).alias("new_this_year"),
        new_sales.alias("new_sales"),
        X.compact_currency(new_sales).alias("new_sales_text"),
    )


def filter_options(df: DataFrame, columns: Sequence[str] = V.CUSTOMER_FILTERS) -> DataFrame:
    """Distinct non-blank values of each column in one pass, as (column, value) rows."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = texts.unpivot([], list(columns), "column", "value")
    return long.filter(X.non_blank(F.col("value"))).distinct()


def natural_key(col: Column) -> Column:
    """Sort key that orders digit runs by value: 'A2' before 'A10' (O06).

    Every digit run loses its leading zeros and gets its length in front, so runs of any length are in order.
    """
    runs = F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(r"(\d+|\D+)"), F.lit(1))

    def number(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=.)", "")
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), number(r)).otherwise(F.lower(r))), "")


def mixed_key(col: Column) -> tuple[Column, Column, Column]:
    """Total order over mixed texts: ISO dates, then numbers, then the rest."""
    text = F.coalesce(col, F.lit(""))
    is_date = text.rlike(r"^\d{4}-\d{2}-\d{2}")
    number = F.when(
        ~is_date, F.regexp_extract(text, r"^\s*([+-]?(\d+\.?\d*|\.\d+))", 1).try_cast("double")
    )
    kind = F.when(is_date, 0).when(number.isNotNull(), 1).otherwise(2)
    return kind, number, text


_ROW_BITS = 33


def numbered(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """All rows with their place in the order, 1 the first; the order must end in a unique column.

    The rows are sorted by range into a working table; a row's place is the number of rows in the partitions before
    its own, one count per partition, and its place inside that.
    """
    placed = working_table(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", _ROW_BITS)
    counts = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    if not counts:
        return placed.withColumnRenamed("__at", name)
    before, starts = 0, []
    for _, n in counts:
        starts.append(before)
        before += n
    offsets = small_table(df.sparkSession, __part=[p for p, _ in counts], __start=starts)
    place = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    return placed.withColumn("__part", part).join(offsets, "__part").withColumn(name, place).drop("__part", "__start", "__at")


#: Rows up to the end of a page that each partition may keep and sort; deeper pages are found by rank.
SHALLOW = 10_000
SPLITS = 64


def page(
    df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 100, place: str | None = None
) -> DataFrame:
    """One page of an ordered table (O08); the order, ascending, must end in a unique column.

    Spark keeps at most ``SHALLOW`` rows per partition for it; of a deeper page it first finds the keys around it.
    ``place`` names a column with the place in the page, 1 the first: its window sees the page alone.
    """
    skip = (number - 1) * size
    if skip + size > SHALLOW:
        df, skip = around_rank(df, order, skip, size)
    rows = df.orderBy(*order).offset(skip).limit(size)
    return rows.withColumn(place, F.row_number().over(Window.orderBy(*order)).cast("bigint")) if place else rows


def around_rank(df: DataFrame, order: Sequence[Column], skip: int, size: int) -> tuple[DataFrame, int]:
    """Rows between two keys that enclose the places after ``skip`` in the order, and how many of them to skip.

    Every turn takes ``SPLITS`` keys by their hash, counts the rows between each two of them in one pass, and goes on
    with those around the page, until few enough are left or nothing more comes off. Nothing is sorted or written;
    the driver sees keys and counts only.
    """
    names = [f"__k{k}" for k in range(len(order))]
    keyed = df.withColumns(dict(zip(names, order, strict=True)))
    key, rows, inside = F.struct(*names), keyed, None
    kinds = keyed.select(*names).schema

    def literal(found: Row) -> Column:
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(found, kinds, strict=True)])

    while inside is None or inside > SHALLOW:
        chosen = rows.select(*names).orderBy(F.xxhash64(*names)).limit(SPLITS).orderBy(*names).collect()
        splits = [literal(r) for r in chosen]
        if not splits:
            break
        cell = F.size(F.filter(F.array(*splits), lambda s: s < key))
        counts = dict(map(tuple, rows.groupBy(cell.alias("cell")).count().collect()))
        total, before = sum(counts.values()), 0
        first, last = None, len(splits)
        for c in range(len(splits) + 1):
            upto = before + counts.get(c, 0)
            if first is None and upto > skip:
                first, start = c, before
            if upto >= skip + size:
                last = c
                break
            before = upto
        if first is None:
            return rows.drop(*names).limit(0), 0
        left = sum(counts.get(c, 0) for c in range(first, last + 1))
        if first > 0:
            rows = rows.filter(key > splits[first - 1])
        if last < len(splits):
            rows = rows.filter(key <= splits[last])
        skip -= start
        if left == total:
            break
        inside = left
    return rows.drop(*names), skip


def page_after(df: DataFrame, key: str, last: object, size: int = 100) -> DataFrame:
    """Page that follows the key of the previous page's last row."""
    rows = df if last is None else df.filter(F.col(key) > F.lit(last))
    return rows.orderBy(key).limit(size)


def with_total(page_rows: DataFrame, whole: DataFrame) -> DataFrame:
    """The page with the row count of the whole table in every row."""
    return page_rows.withColumn("total", whole.agg(F.count("*")).scalar())
