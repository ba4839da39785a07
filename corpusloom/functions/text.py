"""Text functions on Columns. Words are the longest runs of letters or digits of the lower-cased text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters of a word; marks around the part of an error that users see, and what they see without
#: one; blanks that trimming removes.
WORD = r"[\p{L}\p{N}]+"
ERROR_BEGIN, ERROR_END = "-BEGIN USER-FACING ERROR-", "-END USER-FACING ERROR-"
GENERAL_ERROR = "An error occurred during execution of this job."
BLANKS = " \t\n\r\x0b\x0c\x85\xa0  　"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """array<string>; NULL for NULL, empty for a text without words."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(WORD), F.lit(0))


def normal_form(text: Column | str) -> Column:
    """The words joined by one space."""
    return F.array_join(words(text), " ")


def trimmed_lower(text: Column | str) -> Column:
    return F.lower(F.btrim(col(text), F.lit(BLANKS)))


def grams(tokens: Column | str, n: int) -> Column:
    """All runs of n consecutive tokens, each joined by one space, in order; empty if there are fewer than n."""
    t = col(tokens)
    if n == 1:
        return t
    return F.when(
        F.size(t) >= n,
        F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.concat_ws(" ", *[F.get(t, i + k) for k in range(n)])),
    ).otherwise(F.array().cast("array<string>"))


def words_and_operators(text: Column | str) -> Column:
    """Words and the operators & | ( ), in order."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(rf"({WORD}|[&|()])"), F.lit(1))


def sanitized(term: Column | str, keep_operators: bool = True) -> Column:
    """A term as the index knows it: words joined by one space, none beside an operator; without operators only words."""
    if not keep_operators:
        return normal_form(term)
    return F.regexp_replace(F.array_join(words_and_operators(term), " "), r" ?([&|()]) ?", "$1")


def subterms(term: Column | str) -> Column:
    """The parts of a term between operators, in order, empty ones left out."""
    return F.filter(F.transform(F.split(sanitized(term), "[&|()]"), lambda x: F.trim(x)), lambda x: x != "")


def gram_order(gram: Column | str) -> Column:
    return F.size(F.split(col(gram), " "))


def shard_of(gram: Column | str, shards: int = 950) -> Column:
    """The shard's name of an n-gram; physical placement is left to hash partitioning."""
    return F.format_string("shard_%04d", (F.crc32(F.encode(col(gram), "UTF-8")) % shards + 1).cast("int"))


def document_bucket(pmid: Column | str, span: int = 1_000_000) -> Column:
    return F.format_string("documents_%02dm", F.floor(col(pmid) / span).cast("long"))


def short_description(text: Column | str, limit: int = 80) -> Column:
    c = col(text)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def iteration_of(path: Column | str) -> Column:
    """The innermost iteration_N folder of a path as a number; NULL without one, an error if N is no number."""
    return F.try_element_at(F.regexp_extract_all(col(path), F.lit(r"/iteration_([^/]*)(?=/)"), F.lit(1)), F.lit(-1)).cast("int")


def user_error(trace: Column | str) -> Column:
    """The part of an error text that is meant for users; a general sentence unless there is exactly one such part."""
    c = col(trace)
    once = F.size(F.split(c, ERROR_BEGIN)) == 2
    part = F.trim(F.regexp_extract(c, rf"(?s){ERROR_BEGIN}(.*?)(?:{ERROR_END}|$)", 1))
    return F.when(c.isNotNull(), F.when(once, part).otherwise(F.lit(GENERAL_ERROR)))


def file_safe(name: Column | str) -> Column:
    """A name without a URL's scheme, path, tag and dot characters."""
    return F.translate(F.regexp_replace(col(name), r"^\w+://", ""), "/:.", "___")
