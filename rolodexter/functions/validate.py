"""Validity checks, as Columns; null input is not valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import col


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_email(c: Column | str) -> Column:
    x = col(c)
    local, domain = F.substring_index(x, "@", 1), F.substr(x, F.locate("@", x) + 1)
    return _sure((F.length(x) <= 254) & (F.length(local) <= 64) & (F.length(domain) <= 253) & ~F.contains(x, F.lit("..")) & x.rlike("(?i)" + fixed.EMAIL))


def email_domain(c: Column | str) -> Column:
    return F.when(is_email(c), F.lower(F.substring_index(col(c), "@", -1)))


def _under(domain: Column, names: list[str]) -> Column:
    """Whether a domain is one of a short list or below one."""
    out = domain.isin(names)
    for n in names:
        out = out | domain.endswith("." + n)
    return out


def is_role_address(c: Column | str) -> Column:
    return _sure(F.contains(col(c), F.lit("@")) & F.lower(F.substring_index(col(c), "@", 1)).isin(fixed.ROLE_LOCAL_PARTS))


def is_disposable(c: Column | str, domains: list[str]) -> Column:
    return _sure(_under(email_domain(c), domains)) if domains else F.lit(False)


def is_tracking_address(c: Column | str) -> Column:
    """An identifier of a program, a placeholder or an image's name that looks like an address."""
    x = F.lower(F.trim(col(c)))
    local, domain = F.regexp_extract(x, "^(.*)@", 1), F.substring_index(x, "@", -1)
    image = F.lit(False)
    for s in fixed.IMAGE_SUFFIXES:
        image = image | domain.endswith(s)
    machine = local.rlike("^[0-9a-f]{24,}$|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    return _sure(F.contains(x, F.lit("@")) & (local != "") & (domain != "") & (image | _under(domain, fixed.TRACKING_DOMAINS + fixed.PLACEHOLDER_DOMAINS) | machine))


def is_website(c: Column | str) -> Column:
    return _sure((F.length(col(c)) <= 2048) & col(c).rlike("(?i)" + fixed.WEBSITE))


def is_phone(c: Column | str) -> Column:
    digits = F.length(F.regexp_replace(F.substring_index(col(c), "#", 1), "[^0-9]", ""))
    return _sure(col(c).rlike(fixed.PHONE) & digits.between(7, 15))


def is_tax_id(c: Column | str) -> Column:
    """Weighted digit sums divisible by 5; a seventh digit 7 may also count nine less."""
    x = F.when(col(c).rlike("^[0-9]{8}$"), col(c))
    total = F.lit(0)
    for k, w in enumerate(fixed.TAX_ID_WEIGHTS, 1):
        product = F.substring(x, k, 1).cast("int") * w
        total = total + F.floor(product / 10).cast("int") + product % 10
    return _sure((total % 5 == 0) | ((F.substring(x, 7, 1) == "7") & ((total - 9) % 5 == 0)))


def is_company_name(c: Column | str) -> Column:
    x = F.trim(col(c))
    return _sure(F.length(x).between(2, 255) & ~F.lower(x).isin(fixed.NOT_A_COMPANY) & x.rlike(r"(?U)[\w一-鿿]") & ~x.rlike(r"(?U)^\d+$"))


def has_company_marker(c: Column | str) -> Column:
    """Whether a name says that it is a company's."""
    x = F.trim(col(c))
    address = x.rlike(r"[市縣區鄉鎮].*[路街道巷號]|[0-9]+號")
    some = lambda parts: "|".join(p.replace(".", r"\.") for p in parts)
    ends = (F.length(x) >= 4) & x.rlike("(" + some(fixed.NAME_ENDINGS) + ")$") & ~address
    return _sure(x.rlike(some(fixed.NAME_MARKERS)) | ends | F.lower(x).rlike(some(fixed.NAME_MARKERS_LATIN)))


def is_not_a_name(c: Column | str, stopwords: list[str] | None = None) -> Column:
    """Whether a value is plainly no name: blank, long, a stop-word, marks or digits of a date or number alone, an address of the web or of mail."""
    x = F.trim(F.coalesce(col(c), F.lit("")))
    shape = x.rlike(r"(?U)^\W*$|^[\d\s\-/年月日時分:.()]+$|^https?://|^[\w.+\-]+@[\w\-]+\.")
    return (x == "") | (F.length(x) > 80) | shape | (F.lower(x).isin(stopwords) if stopwords else F.lit(False))


def email_verdict(c: Column | str, disposable: list[str] | None = None, has_mx: Column | None = None) -> Column:
    """Empty, Invalid Syntax, Disposable, Unknown (no answer about the mail server), Valid or No MX. has_mx comes from a joined table."""
    x = col(c)
    mx = F.lit(None).cast("boolean") if has_mx is None else has_mx
    out = F.when(x.isNull() | (F.trim(x) == ""), "Empty").when(~is_email(x), "Invalid Syntax").when(is_disposable(x, disposable or []), "Disposable")
    return out.when(mx.isNull(), "Unknown").when(mx, "Valid").otherwise("No MX")


def why_not_a_company(name: Column | str, site: Column | str) -> Column:
    """Null for a company; else the reason. A marker of a company outranks every other sign."""
    raw = F.trim(F.coalesce(col(name), F.lit("")))
    bare = F.trim(F.regexp_replace(raw, r"^[\s\x{2000}-\x{206F}\x{2190}-\x{2BFF}\x{3000}-\x{303F}\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]+", ""))
    low = F.lower(bare)
    marked = F.lit(False)
    for m in fixed.COMPANY_MARKERS:
        marked = marked | F.contains(low, F.lit(m))
    url = F.lower(F.when(F.contains(col(site), F.lit("://")), col(site)).otherwise(F.concat(F.lit("https://"), col(site))))
    host, path = F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1), F.regexp_extract(url, "^[a-z]+://[^/?#]*([^?#]*)", 1)
    article = F.lit(False)
    for p in fixed.ARTICLE_HOST_PREFIXES:
        article = article | host.startswith(p)
    for p in fixed.ARTICLE_PATH_PARTS:
        article = article | F.contains(path, F.lit(p))
    long = F.length(bare) > 30
    return (
        F.when(raw == "", "no name")
        .when(marked, None)
        .when(_sure(article), "site is an article")
        .when(bare.rlike("(?i)" + "|".join(fixed.HEADLINE_PATTERNS)), "name is a headline")
        .when((bare != raw) & long, "name is decorated and long")
        .when(long & bare.rlike("[,，]"), "name is a sentence")
    )
