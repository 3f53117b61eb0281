"""Classification of job titles by ordered patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of titles that are kept, of titles that are not, of roles, of
# titles that are no software role, of levels and of families, in the order they are tried.
INCLUDE = (
    r"(software|data|backend|back-end|frontend|front-end|full ?stack|cloud|devops|platform|security|network|systems?|qa|test|automation|machine learning|ml|ai|embedded|mobile|ios|android|web)\s+(?:engineer|developer|architect)"
    r"|software developer|programmer|data scientist|data analyst|sre|site reliability"
    r"|database administrator|\bdba\b|web developer|application developer"
    r"|\b(?:php|java|python|javascript|typescript|golang|ruby|scala|kotlin|swift|dotnet|\.net|c\+\+|c#|rust|node|react|angular|kubernetes|sailpoint|salesforce|servicenow|sap)\s+(?:developer|engineer|architect)"
    r"|software development engineer|development engineer"
    r"|(?:senior|sr\.?|lead|principal|staff|distinguished)\s+(?:developer|programmer)"
    r"|(?:solutions?|technical|principal|enterprise|cloud|application)\s+architect"
    r"|devsecops|mlops|machine learning operations"
    r"|engineering manager|tech lead|technical lead|product engineer"
    r"|(?:scientist|researcher)\b.*(?:machine learning|\bml\b|\bai\b|nlp|deep learning|computer vision|data|software|algorithm)"
    r"|(?:machine learning|\bml\b|\bai\b|nlp|deep learning|computer vision|research)\s+(?:scientist|researcher|engineer)"
    r"|applied scientist|research engineer"
    r"|game (developer|engineer|programmer)|graphics (developer|engineer|programmer)"
    r"|unity developer|unreal engine|gameplay (engineer|programmer)"
    r"|system(s)? administrator|sysadmin|linux administrator|windows administrator"
)
EXCLUDE = (
    r"electrical|mechanical|civil|structural|manufactur|geotech|chemical|industrial"
    r"|landscape|hvac|aerospace|automotive|petroleum|mining|marine|nuclear|biomedical"
    r"|field engineer|sales engineer|process engineer|controls engineer|quality engineer"
    r"|project engineer|design engineer|hardware engineer|packaging"
    r"|account executive|account manager|bioinformatician|safety architect|ai training"
    r"|clinical|biolog|chemi|pharma|laboratory|environmental scientist|food scientist"
    r"|soil|materials scientist"
)
ROLES = (
    ("AI/ML Engineer", r"machine learning|\bml engineer|\bmlops\b|\bai engineer|deep learning|applied scientist|\bnlp\b|computer vision|generative ai|\bllm\b|research scientist|ai/ml"),
    ("Data Scientist", r"data scientist|decision scientist"),
    ("Data Engineer", r"data engineer|etl (developer|engineer)|analytics engineer|big data|data pipeline|data platform engineer"),
    ("Data or Business Analyst", r"data analyst|business intelligence|\bbi (analyst|developer)|reporting analyst|business analyst"),
    ("Site Reliability Engineer", r"site reliability|\bsre\b|production engineer"),
    ("DevOps Engineer", r"devops|devsecops|platform engineer|release engineer|build engineer|infrastructure automation"),
    ("Cloud Infrastructure Engineer", r"cloud engineer|cloud infrastructure|cloud solution|cloud operations|infrastructure engineer|\baws engineer|\bazure engineer"),
    ("Security Professional", r"security engineer|cyber ?security|infosec|application security|penetration test|incident response|security analyst|security operations|\bsoc analyst"),
    ("Database Administrator", r"database administrator|\bdba\b|database engineer|database developer"),
    ("Developer, Mobile", r"\bmobile\b|\bandroid\b|\bios\b|react native|flutter developer|swiftui"),
    ("Developer, Embedded", r"\bembedded\b|\bfirmware\b|device driver|\brtos\b"),
    ("Developer, Game or Graphics", r"game (developer|engineer|programmer|play)|graphics (developer|engineer|programmer)|unity developer|unreal engine"),
    ("Developer, QA or Test", r"\bqa\b|quality assurance|\bsdet\b|test automation|automation test|software test|\btester\b|test engineer.*softwar|software.*test engineer"),
    ("Developer, Front-end", r"front[- ]?end|\bui developer|\bui engineer|web developer|react developer|angular developer|vue developer"),
    ("Developer, Back-end", r"back[- ]?end|server[- ]side"),
    ("Developer, Full-stack", r"full[- ]?stack"),
    ("Network Engineer", r"network (engineer|architect|administrator|automation|operations)|\bddi\b|routing and switching|\bnoc\b"),
    ("System Administrator", r"system(s)? administrator|sysadmin|windows (engineer|administrator)|linux (engineer|administrator)"),
    ("Engineering Manager", r"engineering manager|development manager|technical lead|tech lead|team lead|\bhead of engineering|director of engineering"),
    ("Developer, Desktop or Enterprise", r"salesforce|servicenow|\bsap\b|sharepoint|sailpoint|dynamics 365|erp (developer|consultant)|\bpega\b|\bepic\b"),
    ("Architect, Software or Solutions", r"\barchitect\b"),
    ("Software Engineer", r"software (engineer|developer|architect)|programmer|application developer|development engineer|\bsde\b|product engineer|\bdeveloper\b|software.*engineer|engineer.*software|\bengineer\b"),
)
NO_ROLE = (
    r"plant |turbomachinery|\bfire &|\bhvac\b|mechanical|facilities|manufacturing"
    r"|thermal|vacuum|chemical|civil |structural|aerospace|automotive|electrical"
    r"|biomedical|petroleum|\bfield service|maintenance (technician|engineer)"
    r"|sales engineer|account (executive|manager)|technical writer|recruiter"
)
LEVELS = (
    ("principal", r"\bprincipal\b|\bdistinguished\b|\bfellow\b|\bchief\b|\bvp\b"),
    ("staff", r"\bstaff\b"),
    ("lead", r"\blead\b|\bleading\b|\bhead of\b"),
    ("senior", r"\bsenior\b|\bsr\.?\b|\bexperienced\b"),
    ("junior", r"\bjunior\b|\bjr\.?\b|\bentry[- ]level\b|\bgraduate\b|\bassociate\b|\bintern\b|\btrainee\b|\bapprentice\b"),
)
LEVEL_ORDER = ("junior", "mid", "senior", "staff", "lead", "principal")
FAMILIES = (
    ("Build software", ("Software", "Front", "Back", "Full", "Mobile", "Embedded", "QA", "Test")),
    ("Work with data", ("Data", "AI", "ML", "Analyst")),
    ("Run systems", ("Network", "System", "DevOps", "Security", "Database", "Reliability", "Cloud")),
    ("Design and lead", ("Architect", "Manager")),
)


def any_of(patterns: Sequence[str]) -> str:
    return "|".join(patterns)


def low(title: Column) -> Column:
    return F.lower(F.coalesce(title, F.lit("")))


def is_tech_title(title: Column) -> Column:
    """Kept patterns without any excluded one; a null title is empty."""
    return low(title).rlike(INCLUDE) & ~low(title).rlike(EXCLUDE)


def first_match(text: Column, ordered: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    """Name of the first pattern that occurs in ``text``."""
    out = None
    for name, pattern in ordered:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(F.lit(otherwise))


def role_of(title: Column) -> Column:
    return F.when(low(title).rlike(NO_ROLE), F.lit(None)).otherwise(first_match(low(title), ROLES))


def level_of(title: Column) -> Column:
    return first_match(low(title), LEVELS, "mid")


def family_of(role: Column) -> Column:
    """First family one of whose words is part of the role's name."""
    return first_match(role, [(n, any_of(ws)) for n, ws in FAMILIES])
