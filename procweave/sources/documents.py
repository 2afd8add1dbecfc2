"""Document sources: text files, tables and file lists in request payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.functions.text import null_if_blank, strip
from procweave.operators.ordered import first_per_key
from procweave.operators.segment import page_count, with_pages


def read_text_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per text file that holds anything: id by path, title from the file name, pages by form feed."""
    files = spark.read.text(paths, wholetext=True).withColumn("source", F.col("_metadata.file_path"))
    # Paths are kept as Spark gives them; a title shows what they encode, and a plus is no blank there.
    shown = F.url_decode(F.replace("source", F.lit("+"), F.lit("%2B")))
    named = files.withColumn("title", F.regexp_extract(shown, r"([^/]*?)(?:\.[^./]*)?$", 1))
    docs = with_pages(named.withColumn("doc_id", F.substring(F.sha2("source", 256), 1, 32)), "value")
    return docs.select("doc_id", "title", "source", page_count().alias("page_count"), "pages", F.current_timestamp().alias("uploaded_at"))


# Keys of a request that hold a file's address or name, in order of preference.
URL_KEYS = ["fullPath", "publicUrl", "fileUrl", "url", "path", "pdf_url", "pdf_file_url"]
NAME_KEYS = ["originalFileName", "fileName", "name", "pdf_name", "pdf_file_name"]
SINGLE_KEYS = ["file", "pdf_file", "attachment"]
LIST_KEYS = ["files", "pdf_files", "attachments", "uploaded_files"]


def _pick(json: Column, keys: list[str]) -> Column:
    return F.coalesce(*[null_if_blank(strip(F.get_json_object(json, f"$.{k}"))) for k in keys])


def normalize_file_list(requests: DataFrame, payload: str = "payload") -> DataFrame:
    """(request_id, pos, url, name) of the files a request names: single keys, then lists, then the
    top level; a URL counts once per request."""
    body = F.col(payload)
    single = F.array(*[F.get_json_object(body, f"$.{k}") for k in SINGLE_KEYS])
    lists = F.flatten(
        F.array(
            *[
                F.coalesce(F.from_json(F.get_json_object(body, f"$.{k}"), "array<string>"), F.array().cast("array<string>"))
                for k in LIST_KEYS
            ]
        )
    )
    top = F.when(_pick(body, URL_KEYS).isNotNull(), F.array(body)).otherwise(F.array().cast("array<string>"))
    rows = requests.select("request_id", F.posexplode(F.concat(single, lists, top)).alias("pos", "item")).where("item IS NOT NULL")
    is_object = F.col("item").startswith("{")
    url = F.when(is_object, _pick(F.col("item"), URL_KEYS)).otherwise(null_if_blank(strip("item")))
    name = F.when(is_object, _pick(F.col("item"), NAME_KEYS))
    files = rows.select("request_id", "pos", url.alias("url"), F.coalesce(name, F.lit("")).alias("name")).where("url IS NOT NULL")
    return first_per_key(files, ["request_id", "url"], ["pos"])


def load_people(users: DataFrame, configuration: DataFrame, tenant: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users and agents of a tenant, and its organisation JSON from the chart key or the value itself."""
    own = users.where(F.col("tenant_id") == tenant)
    org = configuration.where((F.col("key") == "organization") & (F.col("tenant_id") == tenant)).select(
        F.coalesce(F.get_json_object("value", "$.chart"), F.col("value")).alias("chart")
    )
    return own, own.where("is_agent"), org
