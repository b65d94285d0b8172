from pyspark.sql import functions as F

from retentia.catalog import query, table
from retentia.functions.scratch import scratch_path
from retentia.sources.tables import convert_table, load_data, save_data

CUSTOMER_SQL = "SELECT * FROM customer"


@query("csv_inferred", CUSTOMER_SQL.replace("*", "* REPLACE (c_custkey::INT AS c_custkey)"))
def csv_inferred(spark, folder):
    path = scratch_path(spark, "customer") + ".csv"
    save_data(table(spark, folder, "customer"), path)
    return load_data(path, spark)


@query("csv_text", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_acctbal::VARCHAR AS c_acctbal, c_mktsegment FROM customer")
def csv_text(spark, folder):
    path = scratch_path(spark, "customer") + ".csv"
    save_data(table(spark, folder, "customer"), path)
    return load_data(path, spark, infer=False)


@query("csv_declared", CUSTOMER_SQL)
def csv_declared(spark, folder):
    """Declared schema and another delimiter."""
    customer = table(spark, folder, "customer")
    path = scratch_path(spark, "customer") + ".csv"
    save_data(customer, path, delimiter=";")
    return load_data(path, spark, schema=customer.schema, delimiter=";")


@query("json_gzip", "SELECT * FROM events")
def json_gzip(spark, folder):
    events = table(spark, folder, "events")
    path = scratch_path(spark, "events") + ".json.gz"
    save_data(events, path)
    return load_data(path, spark, schema=events.schema, partitions=4)


_AWKWARD = """CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 0 THEN NULL
    WHEN doc_id % 13 = 0 THEN concat(' "', text, chr(13), chr(10), chr(92), ' ') ELSE text END"""


@query("convert_documents", f"SELECT doc_id, {_AWKWARD} AS text, lang, source, n_chars FROM documents")
def convert_documents(spark, folder):
    """Texts with line breaks, quotes, blanks and backslashes, empty ones and null, through CSV."""
    documents = table(spark, folder, "documents").withColumn("text", F.expr(_AWKWARD))
    source = scratch_path(spark, "documents") + ".parquet"
    save_data(documents, source)
    return convert_table(source, scratch_path(spark, "documents") + ".csv", spark, schema=documents.schema)


@query("convert_to_csv", CUSTOMER_SQL)
def convert_to_csv(spark, folder):
    schema = table(spark, folder, "customer").schema
    path = scratch_path(spark, "customer") + ".csv"
    return convert_table(f"{folder}/customer.parquet", path, spark, schema=schema)
