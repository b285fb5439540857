"""Texts of logs: ids, paths, addresses, urls, categories, roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REMOVABLE = "R:\\"
INTERNAL_DOMAIN = "dtaa.com"
LARGE_FILE = 5_000_000

# Keyword lists and ladders that results depend on.
CATEGORIES = (
    ("social_media", "facebook|linkedin|twitter"),
    ("cloud_storage", r"dropbox|googledrive|onedrive|box\.com"),
    ("job_search", r"indeed|linkedin\.com|monster|glassdoor"),
    ("file_sharing", r"wikileaks|mega\.nz|mediafire"),
)
SENSITIVE = ("cloud_storage", "file_sharing", "job_search")
SITE_WORDS = {
    "job": "job career linkedin indeed monster",
    "social": "facebook twitter instagram social myspace friendster",
    "cloud": "dropbox onedrive gdrive google.drive icloud box",
    "fileshare": "rapidshare megaupload mediafire zippyshare",
}
SITE_WORDS_WITH_SEARCH = {
    "job": "job career linkedin indeed",
    "social": "facebook twitter instagram social myspace",
    "cloud": "dropbox onedrive gdrive icloud box cloud",
    "fileshare": "mediafire megaupload rapidshare zippyshare",
    "search": "wikipedia google bing yahoo",
}
WEBMAIL = r"@gmail|@yahoo|@hotmail|@outlook|@mail\."
ROLE_LEVELS = ((5, "Admin|Executive|Finance"), (4, "Manager|Director"), (3, "Engineer|Analyst"), (2, "Specialist|Coordinator"))
ROLE_SENSITIVITY = {
    5: "ITAdmin Security Network Database System Admin", 4: "Engineer Developer Programmer",
    3: "Manager Director Executive", 2: "Analyst Specialist", 1: "Salesman Worker Assistant Administrative",
}
DEPARTMENTS = ((1, "administration|admin"), (2, "research|engineering|software"), (3, "sales|marketing"), (4, "manufacturing|production|assembly"), (5, "security"), (6, "hr|human"))
# End of fixed values.


def extracted(text: Column, pattern: str, group: int = 1) -> Column:
    """The group, or null where nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def any_word(text: Column, words: str) -> Column:
    """Whether a lower-cased text holds one of some words."""
    return F.lower(text).rlike("|".join(w.replace(".", r"\.") for w in words.split()))


def ladder(pairs, other: Column, test) -> Column:
    """CASE over (value, condition) pairs, first match wins."""
    out = None
    for value, condition in pairs:
        out = F.when(test(condition), F.lit(value)) if out is None else out.when(test(condition), F.lit(value))
    return out.otherwise(other)


def entity(text: Column) -> Column:
    return F.upper(F.trim(text))


def session_key(user: Column, pc: Column) -> Column:
    return F.concat_ws("_", user, pc)


def operation(path: Column) -> Column:
    return F.when(path.startswith(REMOVABLE), "REMOVABLE_WRITE").when(path.startswith("C:\\Windows"), "SYSTEM_ACCESS").otherwise("FILE_ACCESS")


def valid_user(text: Column) -> Column:
    return text.rlike("^[A-Z]{3}[0-9]{4}$")


def valid_pc(text: Column) -> Column:
    return text.rlike("^PC-[0-9-]*[0-9][0-9-]*$")


def is_removable(path: Column, ignore_case: bool = False) -> Column:
    return (F.upper(path) if ignore_case else path).startswith(REMOVABLE)


def file_extension(path: Column) -> Column:
    return F.lower(extracted(path, r"\.([a-zA-Z0-9]+)$"))


def file_header(content: Column) -> Column:
    return F.split(content, " ")[0]


def recipients(text: Column) -> Column:
    """The addresses of a `;`-delimited list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")


def recipient_count(text: Column, as_written: bool = False) -> Column:
    """Recipients of a list; as written, with empty places."""
    return F.size(F.split(text, ";")) if as_written else F.size(recipients(text))


def distinct_recipients(text: Column) -> Column:
    return F.size(F.array_distinct(F.transform(F.split(text, ";"), lambda x: F.trim(x))))


def sender_domain(address: Column) -> Column:
    return F.lower(extracted(F.trim(address), "@([a-zA-Z0-9.-]+)$"))


def is_internal(address: Column, domain: str = INTERNAL_DOMAIN) -> Column:
    return F.contains(address, F.lit(domain))


def has_external_recipient(text: Column, domain: str = INTERNAL_DOMAIN) -> Column:
    inside = f"[^;]+@{domain.replace('.', '[.]')}"
    return F.coalesce(F.contains(F.regexp_replace(text, inside, ""), F.lit("@")), F.lit(False))


def has_outside_address(text: Column, domain: str = INTERNAL_DOMAIN) -> Column:
    """By look-ahead: an @ that the domain does not follow."""
    return text.rlike(f"@(?!{domain.replace('.', '[.]')})")


def is_webmail(text: Column) -> Column:
    return F.lower(text).rlike(WEBMAIL)


def url_domain(url: Column) -> Column:
    return F.lower(extracted(url, "^https?://([^/]+)"))


def url_path(url: Column, empty: bool = False) -> Column:
    """From the first slash behind the host; without one null, or '' if asked."""
    out = F.regexp_extract(url, "^https?://[^/]+(/.*)", 1)
    return out if empty else F.nullif(out, F.lit(""))


def domain_category(domain: Column) -> Column:
    return ladder(CATEGORIES, F.lit("other"), domain.rlike)


def is_sensitive(category: Column) -> Column:
    return category.isin(*SENSITIVE)


def site_flags(domain: Column, words: dict[str, str] = SITE_WORDS) -> dict[str, Column]:
    return {f"is_{name}": F.coalesce(any_word(domain, own), F.lit(False)) for name, own in words.items()}


def role_level(role: Column) -> Column:
    return ladder(ROLE_LEVELS, F.lit(1), role.rlike)


def role_flags(role: Column) -> dict[str, Column]:
    """Substring rules, by case."""
    return {"is_it_admin": role.rlike("Admin|IT"), "is_manager": role.rlike("Manager|Director|Lead|Head")}


def directory_flags(role: Column) -> dict[str, Column]:
    """The reader's rules, whatever the case."""
    return {"is_it_admin": F.contains(F.upper(role), F.lit("ITADMIN")), "is_manager": F.upper(role).rlike("MANAGER|DIRECTOR|VP|VICE PRESIDENT")}


def role_sensitivity(role: Column) -> Column:
    """By exact name; 1 for others."""
    return ladder([(n, names.split()) for n, names in ROLE_SENSITIVITY.items()], F.lit(1), lambda names: F.trim(role).isin(*names))


def security_role(role: Column) -> Column:
    return any_word(role, "admin security network database system")


def management(role: Column) -> Column:
    return any_word(role, "manager director executive chief head")


def department_id(department: Column) -> Column:
    return F.when(department.isNull(), F.lit(0)).otherwise(ladder(DEPARTMENTS, F.lit(7), F.lower(department).rlike))


def is_large(content: Column, over: int = LARGE_FILE) -> Column:
    """By bytes."""
    return F.octet_length(content) > over


def clipped(x: Column, low: float, high: float) -> Column:
    """x between low and high; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def personality_flags(O: Column, C: Column, A: Column, N: Column) -> dict[str, Column]:  # noqa: E741, N803
    return {"is_high_risk": (N > 35) & (C < 25), "is_disagreeable": (A < 25) & (O > 40), "is_disagreeable_wide": (O > 35) & (A < 25)}


def personality_risk(C: Column, A: Column, N: Column) -> Column:  # noqa: N803
    return clipped(N / 50 + (50 - C) / 50 + (50 - A) / 50, 0.0, 3.0) / 3


def trait_shares(traits: dict[str, Column]) -> dict[str, Column]:
    return {name: clipped(x / 50, 0.0, 1.0) for name, x in traits.items()}


def trait_risk(C: Column, A: Column, N: Column) -> Column:  # noqa: N803
    return clipped(0.5 * N - 0.25 * C - 0.25 * A + 0.5, 0.0, 1.0)


def access_level(sensitivity: Column, dept_size: Column, team_size: Column) -> Column:
    return sensitivity * 10 + dept_size / 100 + team_size / 50


def access_level_small(sensitivity: Column, team_size: Column) -> Column:
    return clipped(sensitivity + F.coalesce(team_size, F.lit(1)), 1, 10)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"\\"), -1)


def shortened(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)
