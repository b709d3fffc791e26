"""Commands as columns: tokens, analysis, validation, responses, and the scalar codecs around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capwindow import schema

# The alphabet of tokens, white space, messages and arities.
TOKEN_SPACE = r"[\t\n ]+"
LEGAL = r"\A[A-Za-z0-9_\-\t\n ]*\z"
INVALID_SYMBOL, INVALID_COMMAND, INVALID_ARGUMENTS = "invalid symbol", "invalid command", "invalid arguments"
KEY_EMPTY, KEY_LONG, NOT_NUMBER = "key cannot be empty", "key length exceeds maximum", "batch is not a number"
ARITY = {"INCR": 2, "GET": 2, "DEL": 2, "WATCH": 2, "MSGSIZE": 0}
UINT64_MAX = "18446744073709551615"


def let(value: Column, use) -> Column:
    """use(value) with value bound to a variable, so that an expression that uses it often stays small in the plan."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(query: Column) -> Column:
    """The words of a query; null where a symbol is illegal."""
    return F.when(query.rlike(LEGAL), F.filter(F.split(query, TOKEN_SPACE), lambda x: x != ""))


def command_id(name: Column) -> Column:
    """The command's number, 0 if unknown."""

    def number(upper: Column) -> Column:
        out = F.lit(schema.COMMANDS["UNKNOWN"])
        for known, code in schema.COMMANDS.items():
            if code:
                out = F.when(upper == known, F.lit(code)).otherwise(out)
        return out

    return let(F.upper(name), number)


def arity_error(number: Column, n_args: Column) -> Column:
    """The analysis error of a command with so many arguments; null if there is none."""
    right = (number == schema.COMMANDS["MDEL"]) & (n_args % 2 == 0)
    for name, n in ARITY.items():
        right |= (number == schema.COMMANDS[name]) & (n_args == n)
    return F.when(number == 0, INVALID_COMMAND).when(~right, INVALID_ARGUMENTS)


def batch_size(text: Column) -> Column:
    """The window length as a number; null if the text is no 64-bit unsigned decimal number."""
    number = F.when(text.rlike(r"\A[0-9]+\z"), F.try_to_number(F.right(text, F.lit(38)), F.lit("9" * 38)))
    number = F.when(F.length(F.ltrim(text, F.lit("0"))) <= 20, number)
    return F.when(number <= F.lit(UINT64_MAX).cast("decimal(38,0)"), number)


def key_error(key: Column, bs_text: Column) -> Column:
    """The first error of a key and its window length; null if both are right."""

    def first(bs: Column) -> Column:
        message = F.concat(F.lit("invalid batch size: "), bs.cast("string"), F.lit(f" (must be between {schema.BATCH_MIN} and {schema.BATCH_MAX})"))
        return (
            F.when(F.octet_length(key) == 0, KEY_EMPTY)
            .when(F.octet_length(key) > schema.KEY_MAX_BYTES, KEY_LONG)
            .when(bs.isNull(), NOT_NUMBER)
            .when((bs < schema.BATCH_MIN) | (bs > schema.BATCH_MAX), message)
        )

    return let(batch_size(bs_text), first)


def parse(df: DataFrame, query_col: str = "query", max_message: int = schema.MAX_MESSAGE) -> DataFrame:
    """df with command_id, arguments and error. Size is checked first, then symbols, the command, its arity and its keys."""
    query = F.col(query_col)
    too_long = F.concat(F.lit("message size "), F.octet_length(query), F.lit(f" exceeds maximum {max_message}"))

    def shape(words: Column) -> Column:
        args = F.when(F.size(words) > 0, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
        number = F.coalesce(command_id(F.get(words, F.lit(0))), F.lit(0))
        return F.struct(number.alias("command_id"), args.alias("arguments"), words.isNull().alias("illegal"))

    def judged(p: Column) -> Column:
        number, args = p["command_id"], p["arguments"]
        errors = F.transform(F.sequence(F.lit(0), (F.size(args) / 2).cast("int") - 1), lambda i: key_error(F.get(args, 2 * i), F.get(args, 2 * i + 1)))
        keyed = (number != schema.COMMANDS["MSGSIZE"]) & (F.size(args) >= 2)
        pair = F.when(keyed, F.get(F.filter(errors, lambda e: e.isNotNull()), F.lit(0)))
        error = F.when(F.octet_length(query) > max_message, too_long).when(p["illegal"], INVALID_SYMBOL).otherwise(F.coalesce(arity_error(number, F.size(args)), pair))
        return F.struct(number.alias("command_id"), args.alias("arguments"), error.alias("error"))

    parsed = let(let(tokens(query), shape), judged)
    return df.withColumn("__parsed", parsed).select("*", "__parsed.*").drop("__parsed")


def respond(result: Column, error: Column) -> Column:
    """The wire form of a result or an error."""
    return F.when(error.isNotNull(), F.concat(F.lit("err|"), error)).otherwise(F.concat(F.lit("ok|"), result.cast("string")))


def unsigned(value: Column) -> Column:
    """A 32-bit counter as the wire prints it: negative values wrap to 64 bits."""
    wrapped = ((value + F.lit(1 << 31)) % F.lit(1 << 32) + F.lit(1 << 32)) % F.lit(1 << 32) - F.lit(1 << 31)
    return F.when(wrapped < 0, (wrapped.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(wrapped.cast("decimal(20,0)")).cast("string")


def response_parts(response: Column) -> tuple[Column, Column]:
    """Status and payload: what stands before and after the first bar."""
    at = F.instr(response, "|")
    return F.when(at > 0, F.substring(response, F.lit(1), at - 1)).otherwise(response), F.when(at > 0, F.substring(response, at + 1, F.length(response)))


def size_bytes(text: Column) -> Column:
    """Bytes of a size literal such as 20, 20B, 4KB or 1Gb; null if it is none."""
    digits, unit = F.regexp_extract(text, r"\A([0-9]+)(GB|Gb|gb|MB|Mb|mb|KB|Kb|kb|B|b|)\z", 1), F.regexp_extract(text, r"\A([0-9]+)(GB|Gb|gb|MB|Mb|mb|KB|Kb|kb|B|b|)\z", 2)
    shift = F.when(F.upper(unit) == "GB", 30).when(F.upper(unit) == "MB", 20).when(F.upper(unit) == "KB", 10).otherwise(0)
    factor = F.when(shift == 30, F.lit(1 << 30)).when(shift == 20, F.lit(1 << 20)).when(shift == 10, F.lit(1 << 10)).otherwise(F.lit(1)).cast("bigint")
    return F.when(digits != "", digits.cast("bigint") * factor)


def time_hex(t: Column) -> Column:
    return F.lower(F.hex(t))


def hex_time(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("bigint")


def partition_of(key: Column, partitions: int = schema.HASH_PARTITIONS) -> Column:
    """A polynomial hash of the key's bytes modulo 2^32, modulo the number of partitions. Keys are ASCII."""
    codes = F.transform(F.filter(F.split(key, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: (h * schema.HASH_FACTOR + c) % (1 << 32)) % partitions
