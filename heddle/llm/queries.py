"""Queries of the text operators (problems 2, 3, 6, 8, 9 and 10) and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import forms, leak, mojibake, names, sentences, tokens
from heddle.session import load


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.same_main_entry(load(spark, sf, "bib"))


def p2_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Every spelling with the entity it was attributed to."""
    headings = names.bib_headings(load(spark, sf, "bib"))
    return names.attribute(headings.select("kind", "name", "dates"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    bib, term = load(spark, sf, "bib", "subject_term")
    titles = bib.select(F.col("bib_id").alias("id"), F.col("title_sort").alias("text"))
    by_title = forms.same_reading(titles, titles).filter("left_id < right_id")
    terms = term.select(F.col("term_id").alias("id"), F.col("term").alias("text"))
    subjects = forms.subfields(bib).filter(forms.is_subject(F.col("tag"), F.col("code"))).select(F.col("bib_id").alias("id"), F.col("value").alias("text"))
    by_subject = forms.same_reading(terms, subjects)
    return by_title.select(F.lit("title").alias("kind"), "left_id", "right_id").unionByName(
        by_subject.select(F.lit("subject").alias("kind"), "left_id", "right_id")
    ).distinct()


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Titles and subjects by class of equal readings, with the number of spellings of each."""
    bib, term = load(spark, sf, "bib", "subject_term")
    subjects = forms.subfields(bib).filter(forms.is_subject(F.col("tag"), F.col("code"))).select(F.concat(F.lit("bib-"), "bib_id").alias("id"), F.col("value").alias("text"))
    texts = bib.select(F.concat(F.lit("title-"), "bib_id").alias("id"), F.col("title_sort").alias("text")).unionByName(subjects)
    return forms.reading_classes(texts.unionByName(term.select(F.concat(F.lit("term-"), "term_id").alias("id"), F.col("term").alias("text"))))


def sourced(bib: DataFrame) -> DataFrame:
    """The subfields of bib with their source: the coding that the record's leader states."""
    coding = F.substring(F.col("marc_record.leader"), 10, 1).alias("source")
    fields = bib.select("bib_id", coding, F.posexplode("marc_record.datafield").alias("pos", "f"))
    return fields.select("bib_id", "source", (F.col("pos") + 1).alias("field_no"), F.explode("f.subfield").alias("s")).select(
        "bib_id", "source", "field_no", F.col("s.code").alias("code"), F.col("s.value").alias("value")
    )


def _restored(spark: SparkSession, sf: str) -> DataFrame:
    values = sourced(load(spark, sf, "bib"))
    model, _ = mojibake.learn(values)
    return mojibake.restore(values, model)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _restored(spark, sf).filter("garbled").select("bib_id", "field_no", "code").distinct()


def p6_restored(spark: SparkSession, sf: str) -> DataFrame:
    """The garbled subfields with their text, null where it cannot be had."""
    return _restored(spark, sf).filter("garbled").select("bib_id", "field_no", "code", "value", "restored").distinct()


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(load(spark, sf, "documents"), "doc_id", "text", path=tokens.tokenizer_file())


def p8_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """The texts again, from their ids."""
    return tokens.decode(p8_ids(spark, sf), "doc_id", path=tokens.tokenizer_file())


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    documents, items = load(spark, sf, "documents", "eval_item")
    return leak.search(leak.build_index(documents, "doc_id", "text"), items, "item_id", "passage")


def p9_near(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve of thirteen words of a passage in order, with up to three others among them."""
    documents, items = load(spark, sf, "documents", "eval_item")
    return leak.search(leak.build_index(documents, "doc_id", "text"), items, "item_id", "passage", near=(12, 3))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_ends(load(spark, sf, "documents"), "doc_id", "text")


QUERIES = {q.__name__: q for q in (p2_found, p2_entities, p3_found, p3_classes, p6_found, p6_restored, p8_ids, p8_decoded, p9_found, p9_near, p10_found)}

_SUBJECTS = """SELECT DISTINCT bib_id, s.value AS text FROM (
  SELECT bib_id, unnest(f.subfield) AS s FROM (SELECT bib_id, unnest(marc_record.datafield) AS f FROM bib) WHERE f.tag = '650') WHERE s.code = 'a' AND s.value IS NOT NULL"""
_WORDS = "regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"
_GRAMS = "SELECT DISTINCT {id}, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i : i + 12], ' '))) AS gram FROM (SELECT {id}, {words} AS w FROM {table}) WHERE len(w) >= 13"

def _independent(column: str) -> str:
    """DuckDB's expression for a reading, put together apart from the operator: Latin letters with their accents off and on again, no table of the operator's."""
    alike = {"А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j",
             "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "Ё": "Ë", "ё": "ë", "Ї": "Ï", "ї": "ï", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
             "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "ρ": "p", "ӏ": "l", "ԛ": "q", "ԝ": "w"}
    out = f"regexp_replace(nfc_normalize({column}), '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}\\x{{34F}}\\x{{FE00}}-\\x{{FE0F}}]', '', 'g')"
    out = f"translate({out}, '{''.join(alike)}', '{''.join(alike.values())}')"
    wide = "".join(map(chr, range(0xFF01, 0xFF5F))).replace(chr(0xFF07), "")
    narrow = "".join(chr(ord(c) - 0xFEE0) for c in wide)
    out = f"translate({out}, '{wide}', '{narrow}')"
    for ligature, letters in (("＇", "''"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬆ", "st"), ("ĳ", "ij"), ("Ĳ", "IJ")):
        out = f"replace({out}, '{ligature}', '{letters}')"
    out = f"regexp_replace(nfc_normalize({out}), '[\\x{{2010}}\\x{{2011}}\\x{{FE63}}\\x{{2043}}]', '-', 'g')"
    return f"trim(regexp_replace({out}, '[\\x{{9}}-\\x{{D}} \\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))"


ORACLE = {
    "p3_found": f"""WITH t AS (SELECT DISTINCT bib_id, title_sort AS text, {_independent('title_sort')} AS r FROM bib WHERE title_sort IS NOT NULL),
        s AS (SELECT bib_id, text, {_independent('text')} AS r FROM ({_SUBJECTS})),
        h AS (SELECT term_id, term AS text, {_independent('term')} AS r FROM subject_term WHERE term IS NOT NULL)
      SELECT DISTINCT 'title' AS kind, a.bib_id AS left_id, b.bib_id AS right_id FROM t a JOIN t b ON a.r = b.r AND a.bib_id < b.bib_id AND a.text <> b.text WHERE a.r <> ''
      UNION ALL SELECT DISTINCT 'subject', term_id, bib_id FROM h JOIN s ON h.r = s.r AND h.text <> s.text WHERE h.r <> ''""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_found": f"""SELECT DISTINCT doc_id, item_id FROM ({_GRAMS.format(id='doc_id', words=_WORDS.format('text'), table='documents')})
      JOIN ({_GRAMS.format(id='item_id', words=_WORDS.format('passage'), table='eval_item')}) USING (gram)""",
}
