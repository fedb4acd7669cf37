"""Retail order lines from CSV: normalised columns, bad rows told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Source column -> normalised column, as text.
RAW = {
    "InvoiceNo": "invoice_no", "StockCode": "stock_code", "Description": "description", "Quantity": "quantity",
    "InvoiceDate": "invoice_date", "UnitPrice": "unit_price", "CustomerID": "customer_id", "Country": "country",
}
#: Tried in this order, after ISO forms.
DATE_FORMATS = ("M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "d/M/yyyy H:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/M/d H:mm")


def parse_moment(text: Column) -> Column:
    """The first form that fits, as timestamp_ntz; null if none does."""
    text = F.trim(text)
    iso = F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"), F.expr("NULL").cast("timestamp_ntz")
    )
    tried = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS]
    return F.coalesce(text.try_cast("timestamp_ntz"), iso, *tried)


def read_csv(spark: SparkSession, path: str, encoding: str = "cp1252") -> DataFrame:
    """All columns as text; types are decided by ``normalised``.

    Spark reads Latin-1 but not its Windows variant, which differs in 27 of the bytes 0x80 to 0x9F only.
    """
    windows = encoding.lower().replace("-", "") in ("cp1252", "windows1252")
    df = spark.read.csv(path, header=True, encoding="ISO-8859-1" if windows else encoding, multiLine=False, escape='"')
    if windows:
        pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
        read, meant = ("".join(x) for x in zip(*[p for p in pairs if p[1]]))
        df = df.select(*[F.translate(f"`{c}`", read, meant).alias(c) for c in df.columns])
    return df


def normalised(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows): the good in twelve typed columns, the bad as they came with a reason."""
    text = {name: F.trim(F.col(column)) for column, name in RAW.items()}
    quantity = text["quantity"].try_cast("double").try_cast("int")
    price = text["unit_price"].try_cast("double")
    moment = parse_moment(text["invoice_date"])
    reason = (
        F.when(F.coalesce(text["invoice_no"], F.lit("")) == "", "no invoice number")
        .when(quantity.isNull(), "quantity")
        .when(price.isNull(), "unit price")
        .when(moment.isNull(), "date")
    )
    marked = raw.withColumn("_reason", reason)
    customer = F.regexp_replace(text["customer_id"], r"\.0$", "")
    good = marked.where(F.col("_reason").isNull()).select(
        text["invoice_no"].alias("invoice_no"),
        F.coalesce(text["stock_code"], F.lit("")).alias("stock_code"),
        F.coalesce(text["description"], F.lit("")).alias("description"),
        quantity.alias("quantity"),
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss").alias("invoice_datetime"),
        F.date_format(moment, "yyyy-MM-dd").alias("invoice_date"),
        F.date_format(moment, "yyyy-MM").alias("invoice_month"),
        price.alias("unit_price"),
        F.when(customer != "", customer).alias("customer_id"),
        F.coalesce(text["country"], F.lit("")).alias("country"),
        F.round(quantity * price, 4).alias("revenue"),
        F.upper(text["invoice_no"]).startswith("C").cast("int").alias("is_cancellation"),
    )
    return good, marked.where(F.col("_reason").isNotNull()).withColumnRenamed("_reason", "reason")
