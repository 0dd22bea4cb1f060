"""Text cleaning and tokenizing as column expressions, all evaluated in the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The longest token, in bytes.
MAX_TOKEN_BYTES = 98


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def collapse_digits(c: Column) -> Column:
    """Each run of digits, commas and points that begins with a digit becomes one 0."""
    return F.regexp_replace(c, "[0-9][0-9,.]*", "0")


def has_digit(c: Column) -> Column:
    return c.rlike("[0-9]")


def preprocess(c: Column, lower: bool = True, digit: bool = True) -> Column:
    """Clean a text; lines stay lines, blank ones too."""
    c = lower_ascii(c) if lower else c
    return collapse_digits(c) if digit else c


def cut_token(w: Column, most: int = MAX_TOKEN_BYTES) -> Column:
    """The first bytes of an over-long token, without a torn character at the end."""
    head = F.substring(F.encode(w, "UTF-8"), 1, most).cast("string")
    return F.when(F.octet_length(w) <= most, w).otherwise(F.rtrim(F.make_valid_utf8(head), F.lit("�")))


def tokens(line: Column) -> Column:
    """The tokens of a line: parts between blanks and tabs. Carriage returns are dropped anywhere."""
    found = F.filter(F.split(F.replace(line, F.lit("\r"), F.lit("")), "[ \t]+"), lambda w: w != "")
    return F.transform(found, lambda w: cut_token(w))


def field(c: Column, i: int, delimiter: str = ",") -> Column:
    """The i-th field, from 0, of delimited text; null beyond the last."""
    return F.try_element_at(F.split(c, "\\Q" + delimiter + "\\E"), F.lit(i + 1))


def remove_all(c: Column, characters: str) -> Column:
    return F.translate(c, characters, "")


def strip_leading(c: Column, character: str) -> Column:
    return F.ltrim(c, F.lit(character))


def parse(c: Column, kind: str) -> Column:
    """A whole-string conversion; null where the text is no value of that kind."""
    return F.trim(F.replace(c, F.lit("\r"), F.lit(""))).try_cast(kind)


def lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line): a row for each line of each text; a null text has none."""
    split = F.split(F.col(text_col), "\n")
    return df.select(F.col(id_col).alias("doc_id"), F.posexplode(split).alias("line_no", "line"))


def corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lower: bool = True, digit: bool = True) -> DataFrame:
    """(doc_id, line_no, toks): the cleaned and tokenized lines."""
    cleaned = df.select(F.col(id_col).alias("doc_id"), preprocess(F.col(text_col), lower, digit).alias("text"))
    return lines(cleaned).select("doc_id", "line_no", tokens(F.col("line")).alias("toks"))
