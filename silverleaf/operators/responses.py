"""Model responses: contract validation with quarantine, resumable runs, audit upsert, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import between_braces, clean_json, normalize_date, parse_object, round_half_even, scale_box, strip


def _once(df: DataFrame, **columns) -> DataFrame:
    """``df`` with columns behind a generator, which the optimiser doesn't merge with its readers: each is computed once a row."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def validate_responses(df: DataFrame) -> DataFrame:
    """Adds reason (null: valid), outcome, box (pixels) and date. First broken rule wins; a date that is none is kept as data.

    Contract: an object with keys among reasoning (string or null) and Date, Date null or {bbox: four numbers in order within
    [0, 1000], text: a string that is not blank}. What cannot be read is told apart: ``repeated key`` in an object, ``no json``
    at all, and ``no object`` for JSON of another kind.
    """
    kind = lambda c: F.schema_of_variant(c)
    get = lambda c, path, what: F.try_variant_get(c, path, what)
    rows = _once(df, r_clean=clean_json(F.col("raw_text")))
    rows = _once(rows, r_all=parse_object(F.col("r_clean")))
    rows = _once(rows, r_kind=kind("r_all"), r_keys=F.json_object_keys(F.to_json("r_all")), r_why=kind(get("r_all", "$.reasoning", "variant")), r_item=get("r_all", "$.Date", "variant"))
    rows = _once(rows, r_item_kind=kind("r_item"), r_item_keys=F.json_object_keys(F.to_json("r_item")), r_box=get("r_item", "$.bbox", "array<variant>"), r_text=get("r_item", "$.text", "variant"))
    rows = _once(rows, r_kinds=F.transform("r_box", kind), r_xy=F.transform("r_box", lambda x: get(x, "$", "double")), r_date=F.when(kind("r_text") == "STRING", strip(get("r_text", "$", "string"))))
    c = [F.try_element_at("r_xy", F.lit(i + 1)) for i in range(4)]
    number = F.forall("r_kinds", lambda k: k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL"))
    inside = (c[0] >= 0) & (c[0] < c[2]) & (c[2] <= 1000) & (c[1] >= 0) & (c[1] < c[3]) & (c[3] <= 1000)
    is_null = F.col("r_item_kind") == "VOID"
    holds = lambda x: F.coalesce(x, F.lit(False))
    twice = F.from_json(between_braces(F.col("r_clean")), "map<string,string>").isNotNull()
    bad = (F.when(F.col("r_all").isNull(), F.when(holds(twice), "repeated key").otherwise("no json")).when(~holds(F.col("r_kind").startswith("OBJECT")), "no object")
        .when(F.size(F.array_except("r_keys", F.array(F.lit("reasoning"), F.lit("Date")))) > 0, "extra key")
        .when(~F.array_contains("r_keys", "Date"), "no date key")
        .when(~F.coalesce(F.col("r_why").isin("STRING", "VOID"), F.lit(True)), "reasoning type")
        .when(is_null, None)
        .when(~holds(F.array_sort("r_item_keys") == F.array(F.lit("bbox"), F.lit("text"))), "date keys")
        .when(F.coalesce(F.size("r_box"), F.lit(-1)) != 4, "box length").when(~holds(number), "box type")
        .when(~holds(inside), "box range")
        .when(F.coalesce(F.length("r_date"), F.lit(0)) == 0, "blank text"))
    rows = _once(rows, r_reason=bad, r_good=normalize_date(F.col("r_date")))
    ok = F.col("r_reason").isNull() & ~is_null
    return rows.select(*df.columns, F.col("r_reason").alias("reason"), F.when(ok, scale_box(F.col("r_xy"), F.col("width"), F.col("height"))).alias("box"), F.when(ok, F.col("r_good")).alias("date"),
                       F.when(F.col("r_reason").isNotNull(), "failed").when(~ok, "null").when(F.col("r_good").isNull(), "unreadable").otherwise("date").alias("outcome"))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validated.filter("reason is null"), validated.filter("reason is not null")


def plan_resume(inputs: DataFrame, outputs: DataFrame, audit: DataFrame, raw: DataFrame) -> DataFrame:
    """image_id, status: todo, or for finished inputs audited, recovered (raw text is there) or skipped_existing.

    An audit row with a column ``raw_result`` counts only if that is not null: without a result there is nothing to keep.
    """
    if "raw_result" in audit.columns:
        audit = audit.filter("raw_result is not null")
    mark = lambda df, c: df.select("image_id").distinct().withColumn(c, F.lit(True))
    all_ = inputs.join(mark(outputs, "o"), "image_id", "left").join(mark(audit, "a"), "image_id", "left").join(mark(raw, "r"), "image_id", "left")
    return all_.select("image_id", F.when(F.col("o").isNull(), "todo").when(F.col("a"), "audited").when(F.col("r"), "recovered").otherwise("skipped_existing").alias("status"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their key; of rows of ``new`` with one key the last by ``order``, if it is given, else all."""
    new = latest(new, [key], order).select(*new.columns) if order else new
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last well-formed record per key."""
    rest = [c for c in df.columns if c not in keys]  # the columns of ``order`` among them
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def build_reports(items: DataFrame) -> DataFrame:
    """One row per image: its items in order (nested) and how many hold an error."""
    return items.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("idx", "name", "error"))).alias("outputs")).select("image_id", "outputs", F.size("outputs").alias("item_count"), F.size(F.filter("outputs", lambda o: o["error"].isNotNull())).alias("error_count"))


def report_settings(white_balance: bool, denoise: bool, sharpen: str, strength: tuple[float, float] = (3.5, 6.0)) -> Column:
    """The settings that head each report, as a struct; what is switched off is null."""
    on = lambda v: F.lit(v) if denoise else F.lit(None).cast("double" if isinstance(v, float) else "string")
    steps = F.struct(F.lit(denoise).alias("enabled"), on("LAB per-channel fastNlMeansDenoising").alias("algorithm"), on(strength[0]).alias("l_h"), on(strength[1]).alias("ab_h"), on("after white_balance").alias("position"))
    edges = F.struct(F.lit(sharpen).alias("mode"), F.lit("after denoise").alias("position"), (F.lit("LAB L-channel unsharp mask") if sharpen != "off" else F.lit(None).cast("string")).alias("algorithm"))
    return F.struct(F.lit(white_balance).alias("white_balance"), steps.alias("denoise"), edges.alias("sharpen"))


def report_json(items: DataFrame, settings: Column) -> DataFrame:
    """(image_id, report): one JSON text for each image: input, settings, paper_count and its items in order of idx.

    ``items`` has image_id, input, idx, output, vertices and area_vertices (arrays of x, y; rounded to one digit, halves to
    even), used_area_fallback, white_balance (a struct or null) and error; an item with an error holds index and error only.
    """
    keep = {"ignoreNullFields": "false"}
    corners = lambda c: F.transform(c, lambda p: F.array(round_half_even(p["x"], 1), round_half_even(p["y"], 1)))
    good = F.to_json(F.struct(F.col("idx").alias("index"), "output", corners("vertices").alias("vertices"), corners("area_vertices").alias("area_vertices"), "used_area_fallback", "white_balance"), keep)
    text = F.when(F.col("error").isNull(), good).otherwise(F.to_json(F.struct(F.col("idx").alias("index"), "error"), keep))
    told = items.withColumn("text", text).groupBy("image_id").agg(F.min("input").alias("input"), F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("t"))
    head, body = F.to_json(F.struct("input"), keep), F.to_json(settings, keep)
    open_ = lambda c: F.substring(c, F.lit(2), F.length(c) - 2)
    return told.select("image_id", F.concat(F.lit("{"), open_(head), F.lit(","), open_(body), F.lit(',"paper_count":'), F.size("t").cast("string"), F.lit(',"outputs":['), F.array_join("t.text", ","), F.lit("]}")).alias("report"))


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines."""
    reports.select("report").write.mode("overwrite").text(path)


def run_summary(reports: DataFrame) -> DataFrame:
    return reports.agg(F.count(F.lit(1)).alias("image_count"), F.sum("item_count").alias("item_count"), F.sum("error_count").alias("error_count"))


def flatten_envelope(df: DataFrame, instance_id: str | None = None) -> DataFrame:
    """Items of envelopes {Success, Code, Data: {Items: [...]}} that report success; of one instance only, if it is named."""
    item = "array<struct<InstanceID:string,Currency:string,RemainingAmount:string,Status:string>>"
    e = df.select(F.from_json("text", f"Success boolean, Code string, Data struct<Items:{item}>").alias("e")).filter("e.Success and e.Code = 'Success'")
    out = e.select(F.inline("e.Data.Items")).toDF("instance_id", "currency", "remaining_amount", "status")
    return out if instance_id is None else out.filter(F.col("instance_id") == instance_id)
