"""Registered queries. Documents are made of the relational tables; the SQL works
on those tables and knows nothing of JSON, but for ``events.props``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns, sql, tables, variants
from ..operators import equality, native, nested, rows, schema
from ..sources import files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Documents


def order_docs(spark: SparkSession, sf_dir: str, dirty: bool = False) -> DataFrame:
    """``(okey, json)``: an order with its lines. ``dirty`` has nulls and empty strings."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("okey"), F.struct(F.col("l_linenumber").alias("ln"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag")).alias("line"))
    lines = lines.groupBy("okey").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    o = _table(spark, sf_dir, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    if dirty:
        status, priority = F.when(status != "F", status), F.when(~priority.startswith("1"), priority).otherwise("")
    o = o.select(F.col("o_orderkey").alias("okey"), status.alias("status"), priority.alias("priority"))
    return o.join(lines, "okey").select("okey", F.to_json(F.struct("okey", "status", "priority", "lines"), {"ignoreNullFields": "false"}).alias("json"))


def customer_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    region = F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    nation = F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), region.alias("region"))
    doc = F.struct(F.col("c_custkey").alias("ckey"), F.col("c_name").alias("name"), nation.alias("nation"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("c_custkey").alias("ckey"), F.to_json(doc).alias("json"))


def conversation_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select("conv_id", F.to_json(F.struct("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))).alias("json"))


# Queries


def flatten_events_props(spark, sf_dir):
    return rows.flat_object_rows(_table(spark, sf_dir, "events"), "props", ["event_id"])


def flatten_events_exact(spark, sf_dir):
    return rows.flatten_rows(_table(spark, sf_dir, "events"), "props", ["event_id"])


def flatten_order_docs(spark, sf_dir):
    return rows.flatten_rows(order_docs(spark, sf_dir), "json", ["okey"]).drop("ord")


def flatten_orders_native(spark, sf_dir):
    """The same rows with no Python in the plan."""
    return native.leaf_rows(order_docs(spark, sf_dir), "json", ["okey"], others="fail", depth=3).drop("place")


def flatten_order_text(spark, sf_dir):
    flat = order_docs(spark, sf_dir).select("okey", columns.flatten("json").alias("flat"))
    return flat.select("okey", F.length("flat").cast("long").alias("chars"), F.md5("flat").alias("digest"))


def paths_types_customer(spark, sf_dir):
    return rows.path_rows(customer_docs(spark, sf_dir), "json", ["ckey"])


def paths_text_customer(spark, sf_dir):
    return customer_docs(spark, sf_dir).select("ckey", columns.paths_with_types("json").alias("paths"))


def flatten_then_agg(spark, sf_dir):
    found = rows.flatten_rows(order_docs(spark, sf_dir), "json", ["okey"])
    name = F.regexp_replace("path", r"\[\d+\]", "[]")
    return found.groupBy(name.alias("path"), "type").agg(F.count("*").alias("n"), F.countDistinct("value").alias("different"))


def flatten_conversations(spark, sf_dir):
    found = rows.flatten_rows(conversation_docs(spark, sf_dir), "json", ["conv_id"])
    return found.where(F.col("path").endswith(".role")).select("conv_id", "path", "value")


def flatten_typed(spark, sf_dir):
    docs = customer_docs(spark, sf_dir)
    parsed = docs.select(F.from_json("json", "ckey bigint, name string, nation struct<key:int,name:string,region:struct<key:int,name:string>>").alias("c"))
    return rows.typed(parsed, separator="_")


def rebuild_flat_documents(spark, sf_dir):
    found = rows.flatten_rows(customer_docs(spark, sf_dir), "json", ["ckey"])
    return rows.documents(found, ["ckey"])


def remove_nulls_orders(spark, sf_dir):
    docs = order_docs(spark, sf_dir, dirty=True)
    return rows.flatten_rows(docs.select("okey", columns.remove_nulls("json").alias("json")), "json", ["okey"]).drop("ord")


def remove_empty_orders(spark, sf_dir):
    docs = order_docs(spark, sf_dir, dirty=True)
    return rows.flatten_rows(docs.select("okey", columns.remove_empty_strings("json").alias("json")), "json", ["okey"]).drop("ord")


def replace_keys_orders(spark, sf_dir):
    docs = order_docs(spark, sf_dir).select("okey", columns.replace_keys("json", "^(q|f)", "renamed").alias("json"))
    return rows.flatten_rows(docs, "json", ["okey"]).drop("ord")


def replace_values_orders(spark, sf_dir):
    docs = order_docs(spark, sf_dir).select("okey", columns.replace_values("json", "^[[:digit:]]-", "level").alias("json"))
    return rows.flatten_rows(docs, "json", ["okey"]).drop("ord")


def replace_on_rows(spark, sf_dir):
    found = rows.flatten_rows(order_docs(spark, sf_dir), "json", ["okey"]).drop("ord")
    return rows.replace_strings(rows.replace_paths(found, "qty$", "amount"), "^[[:digit:]]-", "level")


def fused_pipeline(spark, sf_dir):
    steps = [columns.remove_nulls_step(), columns.remove_empty_strings_step(), columns.replace_keys_step("^priority$", "urgency"), columns.flatten_step()]
    found = columns.extract("json", steps, members=columns.size_at(), has_urgency=columns.has_at("urgency"), has_status=columns.has_at("status"))
    return order_docs(spark, sf_dir, dirty=True).select("okey", found.alias("x")).select("okey", "x.*")


def schema_orders(spark, sf_dir):
    """The merged schema, as rows."""
    node = schema.merge(order_docs(spark, sf_dir, dirty=True), "json", "okey")
    return spark.createDataFrame(schema.listed(node), "path string, type string, nullable boolean, required boolean")


def schema_single(spark, sf_dir):
    """Schemas of single documents, and how many have each."""
    found = order_docs(spark, sf_dir, dirty=True).select(columns.schema_of("json", pretty=False).alias("schema"))
    return found.groupBy("schema").agg(F.count("*").alias("n"))


def schema_by_group(spark, sf_dir):
    docs = order_docs(spark, sf_dir, dirty=True)
    keyed = docs.join(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("okey"), F.col("o_custkey").alias("cust")), "okey")
    return schema.grouped_schemas(keyed, ["cust"], "json", "okey")


def members_of_orders(spark, sf_dir):
    found = columns.extract(
        "json",
        n_lines=columns.size_at("lines"),
        status=columns.string_at("STATUS"),
        first_qty=columns.number_at("lines", 0, "qty"),
        status_kind=columns.kind_at("status"),
        has_exact=columns.has_at("Status", case_sensitive=True),
        on_error="null",
    )
    return order_docs(spark, sf_dir, dirty=True).select("okey", found.alias("x")).select("okey", "x.*", F.col("x").isNotNull().alias("valid"))


def edited_orders(spark, sf_dir):
    """Members added, replaced and deleted; items inserted."""
    added = columns.put(columns.delete(columns.put("json", "status", '"new"', "replace"), "lines"), "extra", "[1,2]")
    return order_docs(spark, sf_dir).select("okey", columns.put(columns.get(added, "extra"), 0, "0", "insert").alias("extra"), added.alias("json"))


def compared_orders(spark, sf_dir):
    docs = order_docs(spark, sf_dir)
    spaced = F.regexp_replace("json", ",", " ,\n\t/* a comment */ ")
    turned = F.regexp_replace("json", r'^\{("okey":\d+),("status":"[^"]*"),', "{$2,$1,")
    return docs.select("okey", (columns.minify(spaced) == F.col("json")).alias("minified"), columns.compare("json", turned).alias("same_turned"), columns.compare("json", columns.delete("json", "status")).alias("same_without"))


def sql_functions(spark, sf_dir):
    sql.register(spark)
    order_docs(spark, sf_dir, dirty=True).createOrReplaceTempView("graftline_orders")
    return spark.sql("select okey, l.path, l.type, l.value from graftline_orders lateral view inline(json_leaves(json_remove_nulls(json))) l where l.path not like 'lines%'")


def sql_functions_on_bad_text(spark, sf_dir):
    """Texts that aren't JSON have no leaves."""
    sql.register(spark)
    _broken(spark, sf_dir).createOrReplaceTempView("graftline_broken")
    return spark.sql("select okey, l.path, l.type, l.value from graftline_broken lateral view inline(json_leaves(json)) l where json_valid(json)")


def _broken(spark, sf_dir):
    """Orders as documents: of four, one has no colon, one has text after it, one ends within a string."""
    o = _table(spark, sf_dir, "orders")
    whole = F.to_json(F.struct(F.col("o_orderkey").alias("okey"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")))
    case = F.col("o_orderkey") % 4
    json = F.when(case == 1, F.replace(whole, F.lit('"priority":'), F.lit('"priority" '))).when(case == 2, F.concat(whole, F.lit(" x"))).when(case == 3, F.regexp_extract(whole, '^.*"status":"', 0)).otherwise(whole)
    return o.select(F.col("o_orderkey").alias("okey"), json.alias("json"))


def error_places(spark, sf_dir):
    """Where texts stop being JSON, for the dialect that ignores what follows a document and for the strict one."""
    return _broken(spark, sf_dir).select("okey", columns.error_place("json").alias("place"), columns.error_place("json", strict=True).alias("strict_place"), columns.is_valid("json", strict=True).alias("valid"))


def bad_documents(spark, sf_dir):
    return rows.bad_documents(_broken(spark, sf_dir), "json", ["okey"], strict=True)


def put_from_column(spark, sf_dir):
    """Members added, items inserted and members replaced, with values of another column."""
    name = F.concat(F.lit('"'), F.col("c_name"), F.lit('"'))
    docs = _table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), F.lit('{"a":1,"list":[1,2]}').alias("json"))
    listed = columns.put(columns.get("json", "list"), 1, F.col("name"), "insert")
    return docs.select("c_custkey", columns.put("json", "name", F.col("name")).alias("added"), columns.put("json", "A", F.col("name"), "replace").alias("replaced"), listed.alias("inserted"))


def minified_documents(spark, sf_dir):
    """Documents with strings of many thousand characters, and with comments."""
    string = F.repeat(F.lit('x\\"y // z '), 2000)
    spaced = F.concat(F.lit('{ "a" : /* b */ "'), string, F.lit('" , // c\n\t"b" : [ '), F.col("c_custkey"), F.lit(" ] }"))
    docs = _table(spark, sf_dir, "customer").select("c_custkey", columns.minify(spaced).alias("m"))
    return docs.select("c_custkey", F.length("m").cast("long").alias("chars"), F.md5("m").alias("digest"))


_NUMBERS = {"1e20": "1e+20", "1e400": None, "0.1": "0.1", "-0": "0", "1.50": "1.5", "92.0": "92", "123456.7": "123456.7", "2147483648": "2147483648", "0.00001": "1e-05", "-17": "-17", "0.30000000000000004": "0.3"}


def native_numbers(spark, sf_dir):
    """Rows of flat objects, with numbers of every kind."""
    texts = F.array(*[F.lit(x) for x in _NUMBERS])
    json = F.concat(F.lit('{"n": '), F.get(texts, (F.col("c_custkey") % len(_NUMBERS)).cast("int")), F.lit(', "s": "'), F.col("c_name"), F.lit('", "z":null, "t":true}'))
    return rows.flat_object_rows(_table(spark, sf_dir, "customer").select("c_custkey", json.alias("json")), "json", ["c_custkey"])


def schema_of_arrays(spark, sf_dir):
    """A document that is an array is a batch."""
    json = F.when(F.col("c_custkey") % 2 == 0, "[]").otherwise(F.concat(F.lit('[{"a":'), F.col("c_custkey"), F.lit('},{"a":2.5,"b":null}]')))
    found = _table(spark, sf_dir, "customer").select(columns.schema_of(json, pretty=False).alias("schema"))
    return found.groupBy("schema").agg(F.count("*").alias("n"))


def schema_with_gaps(spark, sf_dir):
    """Every seventh document lacks a property, whose inner structure starts anew there."""
    json = F.when(F.col("c_custkey") % 7 == 0, "{}").otherwise(F.concat(F.lit('{"p":{"q":'), F.col("c_custkey"), F.lit("}}")))
    node = schema.merge(_table(spark, sf_dir, "customer").select("c_custkey", json.alias("json")), "json", "c_custkey")
    return spark.createDataFrame(schema.listed(node), "path string, type string, nullable boolean, required boolean")


def schema_of_many_names(spark, sf_dir):
    """Every order is a name of its own: its value is forgotten at the next document."""
    o = _table(spark, sf_dir, "orders")
    json = F.concat(F.lit('{"all":{"n":1},"o'), F.col("o_orderkey"), F.lit('":{"p":"'), F.col("o_orderpriority"), F.lit('"}}'))
    nodes = schema.merged_nodes(o.select("o_orderkey", json.alias("json")), "json", "o_orderkey")
    return nodes.select("path", F.col("kind").alias("type"), "nullable", "required")


def schema_types_by_group(spark, sf_dir):
    docs = order_docs(spark, sf_dir, dirty=True)
    keyed = docs.join(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("okey"), F.col("o_custkey").alias("cust")), "okey")
    found = schema.grouped_schemas(keyed, ["cust"], "json", "okey")
    return found.select("cust", F.get_json_object("schema", "$.properties.status.type").alias("status"), F.get_json_object("schema", "$.required").alias("required"))


def rows_lifted(spark, sf_dir):
    """Rows of a table as documents, and flattened again."""
    docs = files.rows_as_json(_table(spark, sf_dir, "nation"), keep=["n_nationkey"])
    return rows.flatten_rows(docs, "json", ["n_nationkey"])


def _typed_orders(spark, sf_dir):
    """Orders as nested columns, with nulls and empty strings among their members and items."""
    o, lines = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_returnflag") == "N", "").when(F.col("l_returnflag") != "A", F.col("l_returnflag"))
    line = F.struct("l_linenumber", "l_quantity", flag.alias("flag"))
    lines = lines.groupBy(F.col("l_orderkey").alias("okey")).agg(F.sort_array(F.collect_list(line)).alias("l"))
    status, priority = F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")), F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).otherwise("")
    items = F.transform("l", lambda x: F.struct(x["l_linenumber"].alias("ln"), x["flag"].alias("flag")))
    o = o.select(F.col("o_orderkey").alias("okey"), F.struct(status.alias("status"), priority.alias("priority")).alias("head"))
    return o.join(lines, "okey").select("okey", "head", items.alias("lines"), F.transform("l", lambda x: x["flag"]).alias("flags"))


def nested_columns(spark, sf_dir):
    """Nulls and empty strings removed, strings and names replaced, on nested columns."""
    df = nested.remove_empty_strings(nested.remove_nulls(_typed_orders(spark, sf_dir)))
    df = nested.replace_keys(nested.replace_values(df, "^[[:digit:]]-", "level", ["head"]), "^(ln|flags)$", "renamed")
    return df.select("okey", F.col("head.status").alias("status"), F.col("head.priority").alias("priority"), F.to_json("lines", {"ignoreNullFields": "true"}).alias("lines"), F.array_join("renamed", "").alias("flags"))


def removed_on_rows(spark, sf_dir):
    """Null items removed from leaf rows: those after them move up."""
    typed = _typed_orders(spark, sf_dir)
    docs = typed.select("okey", F.to_json(F.struct("okey", "flags", F.transform("lines", lambda x: F.array(x["ln"].cast("string"), x["flag"])).alias("lines")), {"ignoreNullFields": "false"}).alias("json"))
    return rows.remove_null_rows(rows.flatten_rows(docs, "json", ["okey"]), ["okey"]).select("okey", "ord", "path", "value")


def doubled_quantities(spark, sf_dir):
    """Every ``qty`` of the lines doubled, by a Spark expression, in one parse."""
    twice = columns.map_values("json", ("lines", "*", "qty"), lambda text: (text.cast("double") * 2).cast("bigint").cast("string"))
    return order_docs(spark, sf_dir).select("okey", twice.alias("json"))


def members_native(spark, sf_dir):
    """Members through VARIANT, with no Python in the plan."""
    found = variants.extract(
        F.col("json"),
        n_lines=variants.size_at("lines"),
        status=variants.string_at("STATUS"),
        first_qty=variants.number_at("lines", 0, "qty"),
        status_kind=variants.kind_at("status"),
        has_exact=variants.has_at("Status", case_sensitive=True),
    )
    return order_docs(spark, sf_dir, dirty=True).select("okey", found.alias("x")).select("okey", "x.*").withColumn("valid", ~F.col("unsure")).drop("unsure")


def equal_documents(spark, sf_dir):
    """Orders whose documents are equal, with their members turned and other numbers' texts."""
    docs = order_docs(spark, sf_dir)
    turned = docs.select("okey", F.regexp_replace(F.regexp_replace("json", r'^\{("okey":\d+),("status":"[^"]*"),', "{$2 , $1.0,"), r'("ln":\d+),("qty":[0-9.]+),', "$2,$1.00,").alias("json"))
    return equality.equal_documents(docs, turned, "json", "okey", "okey")


def table_function(spark, sf_dir):
    tables.register(spark)
    order_docs(spark, sf_dir).createOrReplaceTempView("graftline_each")
    return spark.sql("select d.okey, t.path, t.type, t.value from graftline_each d, lateral json_each(d.json) t")


def table_function_members(spark, sf_dir):
    tables.register(spark)
    customer_docs(spark, sf_dir).createOrReplaceTempView("graftline_members")
    return spark.sql("select d.ckey, t.ord, t.name, t.type, t.json from graftline_members d, lateral json_each(d.json, 'members') t")


def table_function_schemas(spark, sf_dir):
    tables.register(spark)
    docs = order_docs(spark, sf_dir, dirty=True).join(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("okey"), F.col("o_custkey").alias("cust")), "okey")
    docs.select("cust", "okey", F.col("json").alias("doc")).createOrReplaceTempView("graftline_schemas")
    found = spark.sql("select * from json_schemas(table(select cust, okey, doc from graftline_schemas) partition by cust order by okey)")
    return found.select(F.col("key").cast("long").alias("cust"), "docs", F.get_json_object("schema", "$.properties.status.type").alias("status"))


def sampled_items(spark, sf_dir):
    """Schemas of suppliers' lines, of which those at even steps are looked at; seventh lines of every tenth order are the only numbers that are no integers."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber"))).alias("lines"))
    numbers = F.transform("lines", lambda x: F.when((x["l_linenumber"] == 7) & (x["l_orderkey"] % 10 == 0), F.lit("0.5")).otherwise(x["l_linenumber"].cast("string")))
    json = F.concat(F.lit('{"lines":['), F.array_join(numbers, ","), F.lit("]}"))
    return lines.select("l_suppkey", columns.schema_of(json, pretty=False).alias("schema"))


def root_array_window(spark, sf_dir):
    """Arrays are flattened item by item if one of their first fifty items is a container, and else left as they are."""
    ahead = (F.col("c_custkey") % 100).cast("int")
    json = F.concat(F.lit("["), F.repeat(F.lit("7,"), ahead), F.lit('{"a":{"b":'), F.col("c_custkey"), F.lit("}}]"))
    return _table(spark, sf_dir, "customer").select("c_custkey", columns.flatten(json).alias("flat"))


def long_paths(spark, sf_dir):
    """Paths are cut at 2047 bytes, and none within a character."""
    outer = F.repeat(F.lit("é"), (F.col("c_custkey") % 15 + 1011).cast("int"))
    json = F.concat(F.lit('{"'), outer, F.lit('":{"'), F.col("c_name"), F.lit('":1}}'))
    found = rows.flatten_rows(_table(spark, sf_dir, "customer").select("c_custkey", json.alias("json")), "json", ["c_custkey"])
    return found.select("c_custkey", "path", F.octet_length("path").cast("long").alias("bytes"))


def nesting_limit(spark, sf_dir):
    """A thousand containers in one another are read, and no more."""
    # Of a few bytes a row come long texts, so rows of one small file are dealt out first.
    keys = _table(spark, sf_dir, "customer").select("c_custkey").repartition(4 * spark.sparkContext.defaultParallelism)
    depth = (F.col("c_custkey") % 12 + 994).cast("int")
    json = F.concat(F.lit('{"a":'), F.repeat(F.lit("["), depth), F.col("c_custkey"), F.repeat(F.lit("]"), depth), F.lit("}"))
    found = columns.extract(json, [columns.flatten_step(max_path_bytes=None)], "null", flat=columns.text_at())
    return keys.select("c_custkey", found.alias("x")).select("c_custkey", F.col("x").isNotNull().alias("valid"), "x.flat")


def escaped_texts(spark, sf_dir):
    """Names in escapes, then a pair of surrogates or half of one, which makes the text invalid."""
    name = F.array_join(F.transform(F.split("c_name", ""), lambda c: F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii(c)), 4, "0"))), "")
    high, low = F.lit("\\ud83d"), F.concat(F.lit("\\u"), F.lower(F.hex(F.lit(0xDE00) + F.col("c_custkey") % 50)))
    case = F.col("c_custkey") % 5
    json = F.concat(F.lit('{"t":"'), name, F.lit("\\t\\/\\\""), F.when(case == 0, high).when(case == 1, low).otherwise(F.concat(high, low)), F.lit('"}'))
    docs = _table(spark, sf_dir, "customer").select("c_custkey", json.alias("json"))
    leaf = F.get(columns.leaf_rows("json", on_error="null"), F.lit(0))["value"]
    return docs.select("c_custkey", columns.is_valid("json").alias("valid"), leaf.alias("value"))


def path_statistics(spark, sf_dir):
    found = rows.flatten_rows(customer_docs(spark, sf_dir), "json", ["ckey"])
    return rows.path_statistics(found).select("path", "type", "n")


QUERIES = {
    f.__name__: f
    for f in (
        flatten_events_props, flatten_events_exact, flatten_order_docs, flatten_orders_native, flatten_order_text, paths_types_customer, paths_text_customer,
        flatten_then_agg, flatten_conversations, flatten_typed, rebuild_flat_documents, remove_nulls_orders, remove_empty_orders,
        replace_keys_orders, replace_values_orders, replace_on_rows, fused_pipeline, schema_orders, schema_single, schema_by_group,
        members_of_orders, edited_orders, compared_orders, sql_functions, rows_lifted, path_statistics,
        sql_functions_on_bad_text, error_places, bad_documents, put_from_column, minified_documents, native_numbers, schema_of_arrays, schema_with_gaps, schema_types_by_group, schema_of_many_names,
        equal_documents, table_function, table_function_members, table_function_schemas, nested_columns, removed_on_rows, doubled_quantities, members_native,
        sampled_items, root_array_window, long_paths, nesting_limit, escaped_texts,
    )
}

# SQL

_NUMBER = "case when {0} = floor({0}) then {0}::bigint::varchar else {0}::varchar end"
_LINES = "l as (select l_orderkey as okey, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, l_returnflag) - 1 as i, l_linenumber as ln, l_quantity as qty, l_returnflag as flag from lineitem)"
_O = "o as (select o_orderkey as okey, o_orderstatus as status, o_orderpriority as priority from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey))"
_DIRTY = "o as (select o_orderkey as okey, case when o_orderstatus <> 'F' then o_orderstatus end as status, case when not starts_with(o_orderpriority, '1') then o_orderpriority else '' end as priority from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey))"


def _orders(base: str, qty: str = "qty", flag: str = "flag", status: str = "status", priority: str = "priority", keep: str = "", shown: str = "{0}") -> str:
    """Rows of the leaves of order documents."""
    return f"""with {base}, {_LINES}
        select okey, 'okey' as path, 'integer' as type, okey::varchar as value from o
        union all select okey, 'status', case when status is null then 'null' else 'string' end, {shown.format("status")} from o {keep.format("status")}
        union all select okey, 'priority', 'string', {shown.format("priority")} from o {keep.format("priority")}
        union all select l.okey, 'lines[' || i || '].ln', 'integer', ln::varchar from l join o using (okey)
        union all select l.okey, 'lines[' || i || '].{qty}', case when qty = floor(qty) then 'integer' else 'number' end, {_NUMBER.format("qty")} from l join o using (okey)
        union all select l.okey, 'lines[' || i || '].{flag}', 'string', {shown.format("flag")} from l join o using (okey)"""


_CUSTOMER = "c as (select c_custkey, c_name, n_nationkey, n_name, r_regionkey, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
_PATHS = "(values (0, 'ckey', 'integer'), (1, 'name', 'string'), (2, 'nation.key', 'integer'), (3, 'nation.name', 'string'), (4, 'nation.region.key', 'integer'), (5, 'nation.region.name', 'string')) as p(ord, path, type)"
_EVENTS = "select event_id, 0 as ord, 'k' as path, 'integer' as type, json_extract_string(props, '$.k') as value from events"

_PLACES = """p as (select o_orderkey as okey, length('{"okey":' || o_orderkey || ',"status":"') as string, length('{"okey":' || o_orderkey || ',"status":"' || o_orderstatus || '","priority" ') as colon,
        length('{"okey":' || o_orderkey || ',"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"} ') as rest,
        case o_orderkey % 4 when 1 then colon when 3 then string end as place, case o_orderkey % 4 when 2 then rest else place end as strict_place from orders)"""

_FLAG = "case l_returnflag when 'N' then '' when 'A' then null else l_returnflag end"
_FLAGS = f"f as (select l_orderkey as okey, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, {_FLAG} nulls first) - 1 as i, l_linenumber as ln, {_FLAG} as flag from lineitem)"

ORACLES = {
    "flatten_events_props": _EVENTS,
    "flatten_events_exact": _EVENTS,
    "flatten_order_docs": _orders(_O),
    "flatten_orders_native": _orders(_O),
    "flatten_order_text": f"""with {_O}, {_LINES}, t as (
        select okey, '{{"okey":' || okey || ',"status":"' || status || '","priority":"' || priority || '"' || (
            select string_agg(',"lines[' || i || '].ln":' || ln || ',"lines[' || i || '].qty":' || {_NUMBER.format("qty")} || ',"lines[' || i || '].flag":"' || flag || '"', '' order by i) from l where l.okey = o.okey) || '}}' as x from o)
        select okey, length(x)::bigint as chars, md5(x) as digest from t""",
    "paths_types_customer": f"with {_CUSTOMER} select c_custkey as ckey, ord::int as ord, path, type from c cross join {_PATHS}",
    "paths_text_customer": f"""with {_CUSTOMER} select c_custkey as ckey, '{{"ckey":"integer","name":"string","nation.key":"integer","nation.name":"string","nation.region.key":"integer","nation.region.name":"string"}}' as paths from c""",
    "flatten_then_agg": f"select regexp_replace(path, '\\[\\d+\\]', '[]') as path, type, count(*) as n, count(distinct value) as different from ({_orders(_O)}) group by 1, 2",
    "flatten_conversations": "select conv_id, 'turns[' || (row_number() over (partition by conv_id order by turn, role, text) - 1) || '].role' as path, role as value from conversations",
    "flatten_typed": f"with {_CUSTOMER} select c_custkey as c_ckey, c_name, n_nationkey as c_nation_key, n_name as c_nation_name, r_regionkey as c_nation_region_key, r_name as c_nation_region_name from c",
    "rebuild_flat_documents": f"""with {_CUSTOMER} select c_custkey as ckey, '{{"ckey":' || c_custkey || ',"name":"' || c_name || '","nation.key":' || n_nationkey || ',"nation.name":"' || n_name || '","nation.region.key":' || r_regionkey || ',"nation.region.name":"' || r_name || '"}}' as json from c""",
    "remove_nulls_orders": _orders(_DIRTY, keep="where {0} is not null"),
    "remove_empty_orders": _orders(_DIRTY, keep="where {0} is distinct from ''"),
    "replace_keys_orders": _orders(_O, qty="renamed", flag="renamed"),
    "replace_values_orders": _orders(_O, shown="case when regexp_matches({0}, '^[0-9]-') then 'level' else {0} end"),
    "replace_on_rows": f"select okey, case when path like '%qty' then 'amount' else path end as path, type, case when type = 'string' and regexp_matches(value, '^[0-9]-') then 'level' else value end as value from ({_orders(_O)})",
    "fused_pipeline": f"""with {_DIRTY}, {_LINES} select okey, 1 + (status is not null)::bigint + (priority <> '')::bigint + 3 * (select count(*) from l where l.okey = o.okey) as members,
        priority <> '' as has_urgency, status is not null as has_status from o""",
    "schema_orders": f"""with {_DIRTY}, {_LINES}, q as (select bool_and(qty = floor(qty)) as whole, bool_or(qty = floor(qty)) as some from l join o using (okey)),
        s as (select case when bool_or(status is null) and bool_or(status is not null) then 'mixed' when bool_or(status is null) then 'null' else 'string' end as type, bool_or(status is null) as nulls from o)
        select '' as path, 'object' as type, false as nullable, true as required
        union all select 'okey', 'integer', false, true union all select 'priority', 'string', false, true
        union all select 'status', type, nulls, not nulls from s
        union all select 'lines', 'array', false, true union all select 'lines[]', 'object', false, true
        union all select 'lines[].ln', 'integer', false, true union all select 'lines[].flag', 'string', false, true
        union all select 'lines[].qty', case when whole then 'integer' else 'number' end, false, true from q""",
    "schema_by_group": f"""with {_LINES}, f as (select o_custkey as cust, bool_and(o_orderstatus = 'F') as all_null, bool_or(o_orderstatus = 'F') as some_null, bool_and(qty = floor(qty)) as whole
            from orders join l on okey = o_orderkey where i = 0 group by 1)
        select cust, '{{"$schema":"http://json-schema.org/draft-07/schema#","type":"object","properties":{{"lines":{{"type":"array","items":{{"type":"object","properties":{{"flag":{{"type":"string"}},"ln":{{"type":"integer"}},"qty":{{"type":"'
            || case when whole then 'integer' else 'number' end || '"}}}},"required":["flag","ln","qty"]}}}},"okey":{{"type":"integer"}},"priority":{{"type":"string"}},"status":{{"type":'
            || case when all_null then '["null","null"]' when some_null then '["string","number","integer","boolean","object","array","null"]' else '"string"' end
            || '}}}},"required":["lines","okey","priority"' || case when some_null then '' else ',"status"' end || ']}}' as schema from f""",
    "members_of_orders": f"""with {_DIRTY}, {_LINES} select okey, (select count(*) from l where l.okey = o.okey) as n_lines, status, (select qty::double from l where l.okey = o.okey and i = 0) as first_qty,
        case when status is null then 'null' else 'string' end as status_kind, false as has_exact, true as valid from o""",
    "edited_orders": f"""with {_O} select okey, '[0,1,2]' as extra, '{{"okey":' || okey || ',"status":"new","priority":"' || priority || '","extra":[1,2]}}' as json from o""",
    "compared_orders": f"with {_O} select okey, true as minified, true as same_turned, false as same_without from o",
    "sql_functions": f"""with {_DIRTY} select okey, 'okey' as path, 'integer' as type, okey::varchar as value from o
        union all select okey, 'status', 'string', status from o where status is not null union all select okey, 'priority', 'string', priority from o""",
    "rows_lifted": """select n_nationkey, 0 as ord, 'n_nationkey' as path, 'integer' as type, n_nationkey::varchar as value from nation
        union all select n_nationkey, 1, 'n_name', 'string', n_name from nation union all select n_nationkey, 2, 'n_regionkey', 'integer', n_regionkey::varchar from nation""",
    "equal_documents": f"with {_O} select okey as a, okey as b from o",
    "table_function": _orders(_O),
    "table_function_members": f"""with {_CUSTOMER} select c_custkey as ckey, 0 as ord, 'ckey' as name, 'integer' as type, c_custkey::varchar as json from c union all select c_custkey, 1, 'name', 'string', '"' || c_name || '"' from c
        union all select c_custkey, 2, 'nation', 'object', '{{"key":' || n_nationkey || ',"name":"' || n_name || '","region":{{"key":' || r_regionkey || ',"name":"' || r_name || '"}}}}' from c""",
    "table_function_schemas": """select o_custkey as cust, count(*) as docs, case when bool_and(o_orderstatus = 'F') then '["null","null"]' when bool_or(o_orderstatus = 'F') then '["string","number","integer","boolean","object","array","null"]' else 'string' end as status
        from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey) group by 1""",
    "nested_columns": f"""with {_FLAGS} select o_orderkey as okey, nullif(o_orderstatus, 'F') as status, case when not starts_with(o_orderpriority, '1') then case when regexp_matches(o_orderpriority, '^[0-9]-') then 'level' else o_orderpriority end end as priority,
            '[' || string_agg('{{"renamed":' || ln || case when flag <> '' then ',"flag":"' || flag || '"' else '' end || '}}', ',' order by i) || ']' as lines, coalesce(string_agg(flag, '' order by i), '') as flags
        from orders join f on okey = o_orderkey group by 1, 2, 3""",
    "removed_on_rows": f"""with {_FLAGS}, k as (select okey, row_number() over (partition by okey order by i) - 1 as pos, flag from f where flag is not null),
        p as (select okey, 0 as part, 0 as i, 0 as j, 'okey' as path, okey::varchar as value from (select distinct okey from f)
            union all select okey, 1, pos, 0, 'flags[' || pos || ']', flag from k
            union all select okey, 2, i, 0, 'lines[' || i || '][0]', ln::varchar from f union all select okey, 2, i, 1, 'lines[' || i || '][1]', flag from f where flag is not null)
        select okey, (row_number() over (partition by okey order by part, i, j) - 1)::int as ord, path, value from p join orders on okey = o_orderkey""",
    "doubled_quantities": f"""with {_O}, {_LINES} select okey, '{{"okey":' || okey || ',"status":"' || status || '","priority":"' || priority || '","lines":[' || (
            select string_agg('{{"ln":' || ln || ',"qty":' || (qty * 2)::bigint || ',"flag":"' || flag || '"}}', ',' order by i) from l where l.okey = o.okey) || ']}}' as json from o""",
    "members_native": f"""with {_DIRTY}, {_LINES} select okey, (select count(*) from l where l.okey = o.okey) as n_lines, status, (select qty::double from l where l.okey = o.okey and i = 0) as first_qty,
        case when status is null then 'null' else 'string' end as status_kind, false as has_exact, true as valid from o""",
    "path_statistics": f"with {_CUSTOMER} select path, type, count(*) as n from c cross join {_PATHS} group by 1, 2",
    "schema_single": f"""with {_DIRTY}, {_LINES}, f as (select okey, case when qty = floor(qty) then 'integer' else 'number' end as qty from l where i = 0)
        select '{{"$schema":"http://json-schema.org/draft-07/schema#","type":"object","properties":{{"okey":{{"type":"integer"}},"status":{{"type":' || case when status is null then '["null","null"]' else '"string"' end
            || '}},"priority":{{"type":"string"}},"lines":{{"type":"array","items":{{"type":"object","properties":{{"ln":{{"type":"integer"}},"qty":{{"type":"' || qty || '"}},"flag":{{"type":"string"}}}},"required":["ln","qty","flag"]}}}}}},"required":["okey",'
            || case when status is null then '' else '"status",' end || '"priority","lines"]}}' as schema, count(*) as n
        from o join f using (okey) group by 1""",
    "sql_functions_on_bad_text": """with o as (select * from orders where o_orderkey % 4 in (0, 2))
        select o_orderkey as okey, 'okey' as path, 'integer' as type, o_orderkey::varchar as value from o
        union all select o_orderkey, 'status', 'string', o_orderstatus from o union all select o_orderkey, 'priority', 'string', o_orderpriority from o""",
    "error_places": f"""with {_PLACES} select okey, place, strict_place, strict_place is null as valid from p""",
    "bad_documents": f"""with {_PLACES} select okey, strict_place as place from p where strict_place is not null""",
    "put_from_column": """select c_custkey, '{"a":1,"list":[1,2],"name":"' || c_name || '"}' as added, '{"a":"' || c_name || '","list":[1,2]}' as replaced, '[1,"' || c_name || '",2]' as inserted from customer""",
    "minified_documents": """with m as (select c_custkey, '{"a":"' || repeat('x\\"y // z ', 2000) || '","b":[' || c_custkey || ']}' as m from customer) select c_custkey, length(m)::bigint as chars, md5(m) as digest from m""",
    "native_numbers": f"""with n as (select * from (values {", ".join(f"({i}, {'null' if v is None else chr(39) + v + chr(39)}, '{'integer' if v is not None and v.lstrip('-').isdigit() and abs(int(v)) < 2**31 else 'number'}')" for i, v in enumerate(_NUMBERS.values()))}) as v(i, value, type))
        select c_custkey, 0 as ord, 'n' as path, type, coalesce(value, 'null') as value from customer join n on i = c_custkey % {len(_NUMBERS)}
        union all select c_custkey, 1, 's', 'string', c_name from customer union all select c_custkey, 2, 'z', 'null', null from customer union all select c_custkey, 3, 't', 'boolean', 'true' from customer""",
    "schema_of_arrays": """select case when c_custkey % 2 = 0 then '{}' else '{"$schema":"http://json-schema.org/draft-07/schema#","type":"object","properties":{"a":{"type":"number"},"b":{"type":["null","null"]}},"required":["a"]}' end as schema, count(*) as n from customer group by 1""",
    "schema_with_gaps": """select '' as path, 'object' as type, false as nullable, true as required union all select 'p', 'object', true, false
        union all select 'p.q', 'integer', true, false from customer having max(c_custkey) > max(case when c_custkey % 7 = 0 then c_custkey end)""",
    "schema_of_many_names": """with o as (select o_orderkey, row_number() over (order by o_orderkey) as i, count(*) over () as n from orders)
        select '' as path, 'object' as type, false as nullable, true as required union all select '/all', 'object', false, true union all select '/all/n', 'integer', false, true
        union all select '/o' || o_orderkey, 'object', n > 1, n = 1 from o union all select '/o' || o_orderkey || '/p', 'string', false, true from o where n = 1""",
    "sampled_items": """with l as (select l_suppkey, l_orderkey, l_linenumber, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) - 1 as i, count(*) over (partition by l_suppkey) as n from lineitem),
        f as (select l_suppkey, bool_or(l_linenumber = 7 and l_orderkey % 10 = 0) as mixed from l where i % greatest(1, n // 50) = 0 and i // greatest(1, n // 50) < 50 group by 1)
        select l_suppkey, '{"$schema":"http://json-schema.org/draft-07/schema#","type":"object","properties":{"lines":{"type":"array","items":{"type":"' || case when mixed then 'number' else 'integer' end || '"}}},"required":["lines"]}' as schema from f""",
    "root_array_window": """select c_custkey, case when c_custkey % 100 < 50 then '[' || repeat('{"":7},', (c_custkey % 100)::int) || '{"a.b":' || c_custkey || '}]'
        else '[' || repeat('7,', (c_custkey % 100)::int) || '{"a":{"b":' || c_custkey || '}}]' end as flat from customer""",
    "long_paths": """with m as (select c_custkey, c_name, least(1023, 1011 + c_custkey % 15)::int as m from customer), p as (select c_custkey, repeat('é', m) || '.' || left(c_name, 2046 - 2 * m) as path from m)
        select c_custkey, path, octet_length(encode(path))::bigint as bytes from p""",
    "nesting_limit": """with d as (select c_custkey, (994 + c_custkey % 12)::int as d from customer)
        select c_custkey, d < 1000 as valid, case when d < 1000 then '{"a' || repeat('[0]', d) || '":' || c_custkey || '}' end as flat from d""",
    "escaped_texts": """select c_custkey, c_custkey % 5 > 1 as valid, case when c_custkey % 5 > 1 then c_name || chr(9) || '/"' || chr((128512 + c_custkey % 50)::int) end as value from customer""",
    "schema_types_by_group": """select o_custkey as cust, case when bool_and(o_orderstatus = 'F') then '["null","null"]' when bool_or(o_orderstatus = 'F') then '["string","number","integer","boolean","object","array","null"]' else 'string' end as status,
        case when bool_or(o_orderstatus = 'F') then '["lines","okey","priority"]' else '["lines","okey","priority","status"]' end as required
        from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey) group by 1""",
}
