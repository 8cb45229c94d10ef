"""Document, transcript and intake-merge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuloom.functions import rules
from skuloom.functions.text import norm_text, norm_token
from skuloom.operators import documents as doc
from skuloom.operators import intake_dedupe as dd
from skuloom.operators import transcripts as tr
from skuloom.registry import query
from skuloom.sources.sample_views import order_of


@query("quote_lines")
def line_class(lines):
    return lines.groupBy("doc_id", "line_no", doc.line_class(F.col("text")).alias("kind")).agg(F.count("*").alias("lines"))


@query("documents")
def line_class_documents(documents):
    """Every line of every document text, counted by class."""
    lines = documents.select("source", F.explode(F.split("text", "\n")).alias("text"))
    return lines.groupBy("source", doc.line_class(F.col("text")).alias("kind")).agg(F.count("*").alias("lines"))


@query("quote_lines")
def lines_to_rows(lines):
    return doc.lines_to_rows(lines).groupBy(
        "doc_id", "line_no", "product_name", "brand", "model_sku", "quantity", "price", "room", "category", "notes", "include", "import_type"
    ).agg(F.count("*").alias("copies"))


@query("quote_lines")
def doc_context(lines):
    return doc.document_context(lines)


@query("quote_lines")
def room_annotation(lines):
    text = F.concat_ws(" ", F.col("text"), F.when(F.col("line_no") == 3, F.lit("in the POWDER ROOM")).otherwise(F.lit("")))
    room = doc.room_in(text)
    return lines.select("doc_id", "line_no", "text", room.alias("room"), doc.without_room(F.col("text"), room).alias("rest")).distinct()


@query("quote_lines")
def parsed_documents(lines):
    """Rows with document context and status, each (name, model) once per document."""
    rows = doc.with_context(doc.lines_to_rows(lines), doc.document_context(lines))
    from skuloom.operators.keyed import first_per

    keyed = rows.withColumn("_n", F.lower("product_name")).withColumn("_m", F.lower("model_sku"))
    order = [F.asc("line_no"), F.asc("price"), F.asc("quantity")]
    return first_per(keyed, ["doc_id", "_n", "_m"], order).select(
        "doc_id", "line_no", "product_name", "model_sku", "supplier", "status", "quantity", "price"
    )


def _cells(df):
    return df.withColumn("cells", F.split("cell_text", r"\|"))


@query("quote_cells")
def cells_to_rows(cells):
    return doc.cells_to_rows(_cells(cells)).select(
        "doc_id", "row_no", "product_name", "brand", "model_sku", "quantity", "price", "finish_color"
    )


@query("quote_cells")
def header_forward_fill(cells):
    from skuloom.operators.keyed import carry_down

    head = F.when((F.col("row_no") == 0) | (F.col("row_no") % 7 == 3), F.concat(F.lit("h"), F.col("row_no").cast("string")))
    rows = cells.select("doc_id", "page", "table_no", "row_no", head.alias("own"))
    return carry_down(rows, ["doc_id", "page", "table_no"], "row_no", "own", "header", slice_rows=4).select("doc_id", "row_no", "header")


@query("quote_cells", "quote_lines")
def first_seen_per_doc(cells, lines):
    tables = doc.cells_to_rows(_cells(cells)).select("doc_id", "page", "row_no", "product_name", "model_sku", "price")

    def line_rows(rest):
        return doc.lines_to_rows(rest).select("doc_id", "page", F.col("line_no").alias("row_no"), "product_name", "model_sku", "price")

    kept = doc.prefer_tables(tables, lines.withColumn("page", F.lit(1)), line_rows)
    return kept.select("doc_id", "product_name", "model_sku", "row_no")


def _sides(df):
    parsed = df.withColumns({"doc_id": order_of("row_id"), "position": F.col("row_id")})
    model = parsed.filter(F.col("row_id") % 3 > 0).withColumns(
        {
            "product_name": F.when(F.col("row_id") % 2 == 0, F.concat("product_name", F.lit(" deluxe"))).otherwise(F.lit("")),
            "quantity": F.col("quantity") % 3,
            "notes": F.lit("seen by model"),
        }
    )
    return parsed, model


@query("intake_wide")
def merge_parser_ai(df):
    """Equality stage of the merge: k-th parser row of a model with the k-th model row."""
    parsed, model = _sides(df)
    return doc.merge_by_model(parsed, model).select(
        "doc_id", "model_key", "nth", "p_position", "m_position", "product_name", "quantity", "notes"
    )


@query("intake_wide")
def merge_parser_ai_pairs(df):
    parsed, model = _sides(df)
    return doc.pair_rows(parsed, model)


@query("intake_wide")
def merge_parser_ai_rows(df):
    """Whole merged rows: matched ones, parser rows alone and model rows alone, with the audit of both sides."""
    parsed, model = _sides(df)
    audit = [f"{who}_{c}" for c in doc.AUDITED for who in ("deterministic", "ai", "final")]
    return doc.merge_rows(parsed, model).select(
        "doc_id", "p_position", "m_position", "product_name", "brand", "model_sku", "dimensions", "category", "room", "quantity", "notes",
        "source_type", "status", "include", "parse_confidence", "ai_used", "ai_skipped_reason", "missing_critical_fields_before_ai",
        "missing_critical_fields_after_ai", *audit,
    )


@query("intake_wide")
def choose_final_value(df):
    other = F.when(df.row_id % 2 == 0, F.lit("Model text")).otherwise(F.lit(""))
    return df.select(
        "row_id",
        doc.choose_value(df.product_name, other).alias("product_name"),
        doc.choose_quantity(df.quantity, (df.row_id % 4).cast("long")).cast("long").alias("quantity"),
        doc.choose_notes(df.notes, other).alias("notes"),
    )


def _answers(df):
    n = F.col("row_id").cast("string")
    body = F.concat(
        F.lit('[{"product_name":"'), F.col("product_name"), F.lit('","quantity":"'), (F.col("row_id") % 4).cast("string"),
        F.lit('","room":"'), F.col("room"), F.lit('","product_category":"sofa","confidence_score":"'), (F.col("row_id") % 130).cast("string"),
        F.lit('","review_required":"True"},{"product_name":"second '), n, F.lit('"}]'),
    )
    text = (
        F.when(F.col("row_id") % 4 == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```")))
        .when(F.col("row_id") % 4 == 1, F.concat(F.lit("Sure "), F.replace(body, F.lit('"'), F.lit("”"))))
        .when(F.col("row_id") % 4 == 2, F.lit("no list here"))
        .otherwise(body)
    )
    return df.select(F.col("row_id").alias("doc_id"), text.alias("answer"))


@query("intake")
def json_array_from_text(df):
    return doc.items_of(_answers(df)).select("doc_id", "position", "item.product_name", "item.quantity", "item.room")


@query("intake")
def result_answers(df):
    """Result answers of five forms: fenced object with rows, list, cut list, text cut inside a string, no result."""
    n = F.col("row_id").cast("string")
    one = F.concat(F.lit('{"row_id":"'), n, F.lit('","safe_to_write":true,"image_url":"'), F.col("image_url"), F.lit('","width_in":'), F.col("quantity").cast("string"), F.lit("}"))
    text = (
        F.when(F.col("row_id") % 5 == 0, F.concat(F.lit('```json\n{"rows":['), one, F.lit(","), one, F.lit("]}\n```")))
        .when(F.col("row_id") % 5 == 1, F.concat(F.lit("Result: ["), one, F.lit("] as asked")))
        .when(F.col("row_id") % 5 == 2, F.concat(F.lit("["), F.replace(one, F.lit("true"), F.lit("NaN"))))
        .when(F.col("row_id") % 5 == 3, F.concat(F.lit('{"rows":['), one, F.lit(', {"width_in": 9, "reason": "cut of')))
        .otherwise(F.lit('{"rows":[]}'))
    )
    rows = df.select(F.col("row_id").alias("doc_id"), text.alias("answer"))
    return doc.result_rows(rows).select("doc_id", "position", "parse_status", "result_row_id", "result_safe_to_write", "result_image_url", "result_width_in", "result_reason")


@query("intake")
def ai_item_to_row(df):
    return doc.item_rows(doc.items_of(_answers(df))).select(
        "doc_id", "position", "product_name", "category", "quantity", "room", "notes", "confidence_score", "review_required", "status"
    )


# ---------------------------------------------------------------- transcripts


@query("transcripts")
def transcript_assembly(turns):
    return tr.assemble(turns)


@query("transcripts")
def transcript_dimensions(turns):
    return tr.spoken_dimensions(turns)


@query("transcripts")
def transcript_specs(turns):
    return tr.transcript_specs(turns, ("Width", "Finish / Color", "Price")).drop("evidence")


@query("conversations")
def conversation_fields(turns):
    """The same extraction over the sample conversations (answers are rare there)."""
    return tr.simple_fields(turns, ("Price", "Product Name", "Room", "Supplier"))


@query("conversations")
def number_words(turns):
    return turns.select("conv_id", "turn", tr.number_words(F.col("text")).alias("text"))


@query("intake_wide", "transcripts")
def apply_transcript(df, turns):
    """Every row takes the call about its own part; rows without a model have none."""
    rows = df.withColumn("conv_id", F.regexp_extract("model_sku", r"(\d+)$", 1).try_cast("bigint"))
    specs = tr.transcript_specs(turns, ("Finish / Color",))
    return tr.apply_transcript(rows, specs).select("row_id", "dimensions", "finish_color", "applied", "notes")


@query("intake_wide", "transcripts")
def apply_transcript_overwrite(df, turns):
    """Answers of high or medium confidence replace what is there."""
    rows = df.withColumn("conv_id", F.regexp_extract("model_sku", r"(\d+)$", 1).try_cast("bigint"))
    specs = tr.transcript_specs(turns, ("Finish / Color",))
    return tr.apply_transcript(rows, specs, overwrite=True).select("row_id", "dimensions", "finish_color", "applied", "notes")


# ---------------------------------------------------------------- intake merge


@query("intake_wide")
def intake_dedupe(df):
    more = ["notes", "source_type", "project", "import_type", "color", "status", "dimension_source_url", "include", "quantity", "confidence_score", "review_required"]
    return dd.dedupe_intake(df).select("row_id", *dd.WEIGHTS, *more, "merged")


@query("intake_wide")
def intake_dedupe_rooms(df):
    """Invariant of the merge: every (product, room) with a room survives, and no other appears."""
    out = dd.dedupe_intake(df).filter("merged")
    return (
        out.select(rules.product_key(F.col("brand"), F.col("model_sku")).alias("product_key"), norm_text(F.col("room")).alias("room"))
        .filter("room <> ''")
        .distinct()
    )


@query("intake_wide")
def intake_dedupe_aside(df):
    """Rows that pass the merge untouched."""
    return dd.dedupe_intake(df).filter("not merged").select("row_id", norm_token(F.col("brand")).alias("brand"), "quantity")
