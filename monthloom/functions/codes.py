"""Product, package and application codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad(s: Column, n: int) -> Column:
    """Zeros on the left up to n characters; longer values stay whole."""
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, "0"))


def _once(x: Column, rule) -> Column:
    """rule(x), with x worked out once for a row however often the rule names it."""
    return F.get(F.transform(F.array(x), rule), F.lit(0))


def _groups(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"(\d+)"), F.lit(1))


def _head(s: Column, keep: int) -> Column:
    """All but the last ``keep`` characters."""
    return s.substr(F.lit(1), F.length(s) - keep)


def product_code(s: Column) -> Column:
    """#####-####; a single run of digits needs five or more, the last four being the product."""

    def rule(g: Column) -> Column:
        one = F.try_element_at(g, F.lit(1))
        return F.when(F.size(g) >= 2, F.concat_ws("-", pad(one, 5), pad(F.try_element_at(g, F.lit(2)), 4))).when(
            (F.size(g) == 1) & (F.length(one) >= 5), F.concat_ws("-", pad(_head(one, 4), 5), F.right(one, F.lit(4)))
        )

    return _once(_groups(s), rule)


def package_code(s: Column) -> Column:
    """#####-####-##; two groups get package 00; a single run needs seven digits or more."""

    def rule(g: Column) -> Column:
        at = lambda i: F.try_element_at(g, F.lit(i))
        one = at(1)
        return (
            F.when(F.size(g) >= 3, F.concat_ws("-", pad(one, 5), pad(at(2), 4), pad(at(3), 2)))
            .when(F.size(g) == 2, F.concat_ws("-", pad(one, 5), pad(at(2), 4), F.lit("00")))
            .when(
                (F.size(g) == 1) & (F.length(one) >= 7),
                F.concat_ws("-", pad(_head(one, 6), 5), F.right(_head(one, 2), F.lit(4)), F.right(one, F.lit(2))),
            )
        )

    return _once(_groups(s), rule)


def dashed_package(s: Column) -> Column:
    """Eleven digits without dashes to #####-####-##."""
    d = pad(F.trim(s), 11)
    return F.when(d.rlike(r"^\d{11}$"), F.concat_ws("-", F.substring(d, 1, 5), F.substring(d, 6, 4), F.substring(d, 10, 2)))


def code_in_text(s: Column) -> Column:
    """The first a-b-c after the letters ndc, as it stands there; dashes of any kind or blanks may part it."""
    plain = F.regexp_replace(s, "[\u2013\u2014\u2212]", "-")
    gap = r"[\-\u2010-\u2015\s]+"
    rule = rf"(?i)ndc\s*([0-9]{{1,5}}){gap}([0-9]{{1,4}}){gap}([0-9]{{1,2}})"
    part = lambda i: F.regexp_extract(plain, rule, i)
    return F.when(part(1) != "", F.concat_ws("-", part(1), part(2), part(3)))


def _strict(s: Column) -> Column:
    """Runs between dashes of the digits and dashes."""
    kept = F.regexp_replace(s, r"[^\d\-]", "")
    return F.when(kept != "", F.split(kept, "-"))


def strict_package_code(s: Column) -> Column:
    """#####-####-## from one to three runs; a single one must have 11 digits, or 10, read as 5-4-1."""
    made = lambda a, b, c: F.concat_ws("-", pad(a, 5), pad(b, 4), pad(c, 2))

    def rule(p: Column) -> Column:
        at = lambda i: F.try_element_at(p, F.lit(i))
        one = at(1)
        whole = made(F.substring(one, 1, 5), F.substring(one, 6, 4), F.substring(one, 10, 2))
        return (
            F.when(F.size(p) == 3, made(at(1), at(2), at(3)))
            .when(F.size(p) == 2, made(at(1), at(2), F.lit("00")))
            .when((F.size(p) == 1) & F.length(one).isin(10, 11), whole)
        )

    return _once(_strict(s), rule)


def strict_product_code(s: Column) -> Column:
    """#####-#### from the first two runs, or from nine or more digits in one."""

    def rule(p: Column) -> Column:
        at = lambda i: F.try_element_at(p, F.lit(i))
        one = at(1)
        return F.when(F.size(p) >= 2, F.concat_ws("-", pad(one, 5), pad(at(2), 4))).when(
            (F.size(p) == 1) & (F.length(one) >= 9), F.concat_ws("-", F.substring(one, 1, 5), F.substring(one, 6, 4))
        )

    return _once(_strict(s), rule)


def labeler(code: Column) -> Column:
    return pad(F.substring_index(code, "-", 1), 5)


def application_number(s: Column) -> Column:
    """The last six digits, zero-padded; null without digits."""
    d = F.regexp_replace(s, r"\D", "")
    return F.when(d != "", pad(F.right(d, F.lit(6)), 6))


def application_type(s: Column) -> Column:
    t = F.upper(F.regexp_extract(s, r"^\s*([A-Za-z]+)", 1))
    return F.when(t.isin("ANDA", "NDA", "BLA"), t)


def country_suffix(s: Column) -> Column:
    """A country code in brackets at the end."""
    c = F.regexp_extract(s, r"\(([A-Z]{2,3})\)\s*$", 1)
    return F.when(c != "", c)
