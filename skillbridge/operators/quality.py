"""Typing of listing rows and the split into accepted and rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Java's number parser also takes suffixes such as "1.5f"; a SQL database does not.
_FLOAT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf(inity)?)\s*$"

# Fixed value: the class of characters a password must contain one of. The range ")-_"
# spans digits and capitals as well; that is how the rule is, and it is kept.
SPECIAL_CHARACTER = r"""[!@#$%^&*()-_=+\\|\[\]{};:'",.<>/?]"""
UPPERCASE = r"\p{IsUppercase}"

Rules = dict[str, Column]


def _typed(field: T.StructField, source: Column) -> Column:
    if isinstance(field.dataType, T.StringType):
        limit = field.metadata.get("max_length")
        if limit is None:
            return source
        # blanks beyond the limit are cut off, as VARCHAR(n) does
        blanks_only = (F.length(source) > limit) & (F.length(F.rtrim(source)) <= limit)
        return F.when(blanks_only, F.substring(source, 1, limit)).otherwise(source)
    if isinstance(field.dataType, T.DoubleType):
        return F.when(source.rlike(_FLOAT), source.try_cast("double"))
    return source.try_cast(field.dataType)


def conform(df: DataFrame, schema: T.StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """Match text columns to ``schema`` by name and cast them.

    Columns the schema does not know are dropped, missing ones become NULL. The texts as
    they came are kept in a struct ``_raw``, which :func:`table_rules` compares with.
    """
    def source(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    raw = F.struct(*[source(f.name).alias(f.name) for f in schema])
    return df.select(
        *[c for c in keep if c in df.columns],
        *[_typed(f, source(f.name)).alias(f.name) for f in schema],
        raw.alias("_raw"),
    )


def table_rules(schema: T.StructType) -> Rules:
    """The constraints of a table as rules on its conformed rows."""
    rules: Rules = {}
    for field in schema:
        col = F.col(field.name)
        if not field.nullable:
            rules[f"{field.name}_null"] = col.isNull()
        if "max_length" in field.metadata:
            rules[f"{field.name}_length"] = F.length(col) > field.metadata["max_length"]
        if not isinstance(field.dataType, T.StringType):
            rules[f"{field.name}_cast"] = F.col(f"_raw.{field.name}").isNotNull() & col.isNull()
    return rules


def account_rules(email: str = "email", password: str = "password") -> Rules:
    """What a sign-up must satisfy."""
    mail, word = F.col(email), F.col(password)
    return {
        "email_format": ~F.contains(mail, F.lit("@")),
        "password_uppercase": ~word.rlike(UPPERCASE),
        "password_special": ~word.rlike(SPECIAL_CHARACTER),
    }


def reset_rules(new: str = "new_password", confirm: str = "confirm_password") -> Rules:
    """What a credential reset must satisfy before it is applied as an update."""
    rules = account_rules(password=new)
    del rules["email_format"]
    same = F.coalesce(F.col(new) == F.col(confirm), F.lit(False))
    return {**rules, "password_mismatch": ~same}


def upload_rules(content: str = "pdf_resume", content_type: str = "content_type") -> Rules:
    """What an uploaded file must satisfy; a missing content type is no PDF."""
    return {
        "no_file": F.coalesce(F.length(content) == 0, F.lit(True)),
        "not_pdf": ~F.coalesce(F.col(content_type).startswith("application/pdf"), F.lit(False)),
    }


def check(df: DataFrame, rules: Rules) -> DataFrame:
    """Add ``errors``, the names of the rules a row breaks.

    A rule on a NULL value counts as broken only where the rule itself says so.
    """
    marks = F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    return df.withColumn("errors", F.filter(marks, lambda e: e.isNotNull()))


def split_valid(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule, and the others with their ``errors``."""
    checked = check(df, rules)
    return (
        checked.filter(F.size("errors") == 0).drop("errors"),
        checked.filter(F.size("errors") > 0),
    )
