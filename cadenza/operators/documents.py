"""Documents and vocabularies: addresses, the document codec, transcripts, field merges, change logs, migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMENT = r"(?s)\n<!-- (\{.*\}) -->\n?$"
MESSAGE = T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("type", T.StringType()), T.StructField("payload", T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("call_id", T.StringType()), T.StructField("name", T.StringType())]))])
ROLES = {"user": "prompt", "assistant": "completion", "tool_call": "call", "tool_result": "result"}


def address(uri: Column) -> tuple[Column, Column, Column]:
    """Scheme, path parts, and name of a hierarchical address such as memory://a/b/c."""
    path = F.split(F.regexp_replace(uri, r"^[a-z]+://", ""), "/")
    return F.regexp_extract(uri, r"^([a-z]+)://", 1), F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))), F.element_at(path, -1)


def below(uri: Column, root: str) -> Column:
    """Is the address the root or under it? A part is matched whole."""
    return (uri == root) | uri.startswith(root.rstrip("/") + "/")


def encoded(body: Column, fields: Column) -> Column:
    """A document: its body and one JSON comment at the end."""
    return F.concat(body, F.lit("\n<!-- "), F.to_json(fields), F.lit(" -->\n"))


def decoded(text: Column, schema: str) -> tuple[Column, Column]:
    """Body and fields of an encoded document; the fields are null where there is no comment or it doesn't parse."""
    raw = F.regexp_extract(text, COMMENT, 1)
    return F.regexp_replace(text, COMMENT, ""), F.when(raw != "", F.from_json(raw, schema, {"mode": "PERMISSIVE"}))


def adapted(lines: DataFrame) -> DataFrame:
    """Transcript lines (conv_id, seq, line: JSON of timestamp, type and payload) as messages with the engine's roles; system,
    meta and unknown lines are passed over, and results whose call isn't there before them."""
    m = lines.select("conv_id", "seq", F.from_json("line", MESSAGE).alias("m")).select("conv_id", "seq", F.col("m.payload.role").alias("role"), F.col("m.payload.text").alias("text"), F.col("m.payload.call_id").alias("call_id"), F.col("m.type").alias("kind"))
    m = m.where((F.col("kind") == "message") & F.col("role").isin(*ROLES)).drop("kind")
    return _answered(m)


def _answered(m: DataFrame) -> DataFrame:
    """Messages in the engine's roles, without results whose call isn't there before them."""
    w = Window.partitionBy("conv_id", "call_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    called = F.coalesce(F.max(F.col("role") == "tool_call").over(w), F.lit(False))
    named = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return m.withColumn("called", called).where((F.col("role") != "tool_result") | F.col("called")).select("conv_id", "seq", F.element_at(named, F.col("role")).alias("role"), "text", "call_id")


def _parts(m: DataFrame, parts: Column) -> DataFrame:
    """A message's parts (role, text, call_id) as messages; their place in it follows its own after a dot. Empty texts go."""
    each = m.select("conv_id", F.col("seq").alias("line"), F.posexplode(parts).alias("at", "part")).select("conv_id", (F.col("line") * 1000 + F.col("at")).alias("seq"), "part.role", "part.text", "part.call_id")
    return _answered(each.where(F.col("role").isin(*ROLES) & ((F.col("role") != "user") & (F.col("role") != "assistant") | (F.coalesce("text", F.lit("")) != ""))))


def _part(role: Column, text: Column, call: Column) -> Column:
    return F.struct(role.alias("role"), text.cast("string").alias("text"), call.cast("string").alias("call_id"))


def adapted_chat(lines: DataFrame) -> DataFrame:
    """Messages of a chat completions call (conv_id, seq, line: JSON of role, content, tool_calls, tool_call_id) as messages with
    the engine's roles: an assistant's text and then its calls, each of name and arguments; answers of tools that were called.
    System and developer messages are passed over. seq counts 1000 a line and one a part."""
    kind = "role string, content string, tool_call_id string, tool_calls array<struct<id:string,function:struct<name:string,arguments:string>>>"
    m = lines.select("conv_id", "seq", F.from_json("line", kind).alias("m"))
    none, r = F.lit(None).cast("string"), F.col("m.role")
    own = F.when(r == "tool", _part(F.lit("tool_result"), F.col("m.content"), F.col("m.tool_call_id"))).otherwise(_part(r, F.col("m.content"), none))
    calls = F.transform(F.coalesce("m.tool_calls", F.array().cast("array<struct<id:string,function:struct<name:string,arguments:string>>>")), lambda c: _part(F.lit("tool_call"), F.concat_ws(" ", c["function"]["name"], c["function"]["arguments"]), c["id"]))
    return _parts(m.where(r.isin("user", "assistant", "tool")), F.concat(F.array(own), F.when(r == "assistant", calls).otherwise(F.slice(calls, 1, 0))))


def adapted_blocks(lines: DataFrame) -> DataFrame:
    """Messages of content blocks (conv_id, seq, line: JSON of role and content, a list of text, tool_use and tool_result blocks) as
    messages with the engine's roles, a block each; other blocks are passed over. seq counts 1000 a line and one a block."""
    kind = "role string, content array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string>>"
    m = lines.select("conv_id", "seq", F.from_json("line", kind).alias("m")).where(F.col("m.role").isin("user", "assistant"))
    none = F.lit(None).cast("string")
    block = lambda c: (
        F.when(c["type"] == "text", _part(F.col("m.role"), c["text"], none)).when((c["type"] == "tool_use") & (F.col("m.role") == "assistant"), _part(F.lit("tool_call"), F.concat_ws(" ", c["name"], c["input"]), c["id"]))
        .when((c["type"] == "tool_result") & (F.col("m.role") == "user"), _part(F.lit("tool_result"), c["content"], c["tool_use_id"]))
    )
    return _parts(m, F.filter(F.transform("m.content", block), lambda x: x.isNotNull()))


def appended(current: Column, added: Column) -> Column:
    """A list field with what is new, in order, without doubles."""
    return F.array_distinct(F.concat(F.coalesce(current, F.array().cast("array<string>")), F.coalesce(added, F.array().cast("array<string>"))))


def replayed(log: DataFrame) -> DataFrame:
    """The vocabulary that a change log (version, class_id, op, name) leaves: the last change of each class, without those it
    retired. Fails if versions have holes or repeat."""
    span = log.agg(F.count_distinct("version").alias("d"), F.count("*").alias("n"), F.max("version").alias("b"), F.min("version").alias("a")).first()
    if span["n"] and not span["d"] == span["n"] == span["b"] - span["a"] + 1:
        raise ValueError("the change log's versions don't follow each other")
    last = log.groupBy("class_id").agg(F.max_by(F.struct("op", "name", "version"), "version").alias("x"))
    return last.where("x.op <> 'retire'").select("class_id", F.col("x.name").alias("name"), F.col("x.version").alias("version"))


def restamped(records: DataFrame, moves: DataFrame) -> DataFrame:
    """Records with the class that moves (uri, was, becomes) give them, where they still have the class it was."""
    j = records.join(moves.select("uri", "was", "becomes"), "uri", "left")
    hit = F.col("kind") == F.col("was")
    return j.withColumn("moved", F.coalesce(hit, F.lit(False))).withColumn("kind", F.when(F.col("moved"), F.col("becomes")).otherwise(F.col("kind"))).drop("was", "becomes")


def compactable(facts: DataFrame, key: list[str], window: int) -> DataFrame:
    """Facts of each account (key, at_us, uri) that `window` later ones make old enough to be kept as a tally alone."""
    w = Window.partitionBy(*key).orderBy(F.col("at_us").desc(), F.col("uri").desc())
    return facts.withColumn("r", F.row_number().over(w)).where(F.col("r") > window).drop("r")


def condition_parts(text: Column) -> Column:
    """Conditions joined by a plus, each as template, field and value; sorted, so a set of them has one text."""
    one = lambda x: F.struct(F.substring_index(x, ":", 1).alias("template"), F.when(x.contains("="), F.substring_index(F.substring_index(x, ":", -1), "=", 1)).alias("field"), F.substring_index(F.substring_index(x, ":", -1), "=", -1).alias("value"))
    return F.transform(F.array_sort(F.split(text, r"\+")), one)


def struct_of(fields: list[dict]) -> T.StructType:
    """The schema that a type's field list (name, type, required) declares. Unknown types and doubled names are refused."""
    kinds = {"text": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "flag": T.BooleanType(), "date": T.DateType(), "moment": T.TimestampType(), "list": T.ArrayType(T.StringType())}
    names = [f["name"] for f in fields]
    if len(set(names)) != len(names):
        raise ValueError("a field is declared twice")
    unknown = {f["type"] for f in fields} - set(kinds)
    if unknown:
        raise ValueError(f"unknown types: {sorted(unknown)}")
    return T.StructType([T.StructField(f["name"], kinds[f["type"]], not f.get("required", False)) for f in fields])
