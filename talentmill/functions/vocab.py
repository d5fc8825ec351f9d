"""Fixed vocabularies and patterns of the resume rules.

The values below are fixed: results are only right with exactly these entries.
"""

from __future__ import annotations

import re

# Skill alias -> label.
SKILL_ALIASES = {
    "reactjs": "React", "react.js": "React", "react js": "React",
    "nodejs": "Node.js", "node js": "Node.js", "node": "Node.js",
    "vuejs": "Vue.js", "vue js": "Vue.js",
    "angularjs": "Angular", "angular js": "Angular",
    "nextjs": "Next.js", "next js": "Next.js",
    "typescript": "TypeScript", "ts": "TypeScript",
    "javascript": "JavaScript", "js": "JavaScript",
    "python3": "Python", "python 3": "Python",
    "fastapi": "FastAPI", "fast api": "FastAPI",
    "django rest framework": "Django", "drf": "Django",
    "flask": "Flask",
    "machine learning": "Machine Learning", "ml": "Machine Learning",
    "deep learning": "Deep Learning", "dl": "Deep Learning",
    "natural language processing": "NLP", "nlp": "NLP",
    "computer vision": "Computer Vision", "cv": "Computer Vision",
    "scikit learn": "scikit-learn", "sklearn": "scikit-learn",
    "tensorflow": "TensorFlow", "tf": "TensorFlow",
    "pytorch": "PyTorch", "torch": "PyTorch",
    "amazon web services": "AWS", "aws": "AWS",
    "google cloud platform": "GCP", "gcp": "GCP", "google cloud": "GCP",
    "microsoft azure": "Azure", "azure": "Azure",
    "postgresql": "PostgreSQL", "postgres": "PostgreSQL",
    "mysql": "MySQL", "ms sql": "SQL Server", "mssql": "SQL Server",
    "mongodb": "MongoDB", "mongo": "MongoDB",
    "apache spark": "Spark", "pyspark": "Spark",
    "apache kafka": "Kafka",
    "apache airflow": "Airflow",
    "elasticsearch": "Elasticsearch", "elastic search": "Elasticsearch",
    "kubernetes": "Kubernetes", "k8s": "Kubernetes",
    "docker": "Docker",
    "terraform": "Terraform",
    "ci/cd": "CI/CD", "cicd": "CI/CD",
    "jenkins": "Jenkins",
    "github actions": "GitHub Actions",
    "java spring": "Spring Boot", "spring framework": "Spring Boot",
    "spring boot": "Spring Boot",
    "c sharp": "C#", "c#": "C#", ".net": ".NET", "dotnet": ".NET",
    "golang": "Go", "go lang": "Go",
    "rust lang": "Rust",
    "rest api": "REST API", "restful": "REST API",
    "graphql": "GraphQL",
    "snowflake": "Snowflake",
    "dbt": "dbt",
    "power bi": "Power BI", "powerbi": "Power BI",
    "tableau": "Tableau",
    "salesforce": "Salesforce", "sfdc": "Salesforce",
    "sap": "SAP",
}

# Skills recognised by name.
KNOWN_SKILLS = (
    "python", "java", "javascript", "typescript", "react", "node.js", "angular",
    "vue.js", "next.js", "aws", "azure", "gcp", "docker", "kubernetes", "terraform",
    "postgresql", "mysql", "mongodb", "redis", "kafka", "spark", "airflow",
    "machine learning", "deep learning", "nlp", "computer vision", "scikit-learn",
    "tensorflow", "pytorch", "xgboost", "lightgbm", "pandas", "numpy",
    "fastapi", "django", "flask", "spring boot", "go", "rust", "c#", ".net",
    "scala", "kotlin", "swift", "sql", "nosql", "graphql", "rest api",
    "snowflake", "dbt", "power bi", "tableau", "salesforce", "sap",
    "ci/cd", "jenkins", "github actions", "git", "linux", "bash",
    "elasticsearch", "dynamodb", "cassandra", "oracle", "hive", "hadoop",
)

# Visa status -> keywords, searched as substrings.
VISA_KEYWORDS = {
    "citizen": ("us citizen", "u.s. citizen", "united states citizen", "american citizen", "usc"),
    "gc": ("green card", "permanent resident", "gc holder", "lawful permanent"),
    "h1b": ("h1b", "h-1b", "h1-b", "h 1b"),
    "opt": ("opt", "f1 opt", "f-1 opt", "optional practical training"),
    "stem_opt": ("stem opt", "stem extension", "stem opt extension"),
    "ead": ("ead", "employment authorization", "employment auth"),
}

# The first status of this list with a hit wins.
VISA_PRIORITY = ("stem_opt", "citizen", "gc", "h1b", "ead", "opt")

# Unicode white space as one portable character class body; the plain \s of the
# JVM and of RE2 covers ASCII only.
WS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# The same characters spelled out, for trimming.
WS_CHARS = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)

# Word characters: letters, numbers, underscore.
WORD = r"\p{L}\p{N}_"

# Contact and experience patterns.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = rf"(\+?1?[{WS}]?)?(\(?\p{{Nd}}{{3}}\)?[{WS}.\-]?)(\p{{Nd}}{{3}}[{WS}.\-]?\p{{Nd}}{{4}})"
# At least this much of a phone number has to be there.
PHONE_TAIL = rf"\p{{Nd}}{{3}}[{WS}.\-]?\p{{Nd}}{{4}}"
MONTH = rf"(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?[{WS}]+)?"
# A month in front of the first year takes no part in the result; a pattern that
# starts with a digit is found much faster.
YEAR_RANGE = rf"(?i)([0-9]{{4}})[{WS}]*[-–—][{WS}]*{MONTH}([0-9]{{4}}|present|current|now)"
YEARS_STATED = rf"(?i)([0-9]+)\+?[{WS}]+years?[{WS}]+(?:of[{WS}]+)?experience"
OPEN_ENDED = ("present", "current", "now")
FIRST_YEAR = 1980

# A line of 2 to 4 alphabetic words.
NAME_LINE = r"^\p{L}+( +\p{L}+){1,3}$"

# Accepted resume file types.
RESUME_TYPES = ("pdf", "docx", "doc")


def skill_label(term: str) -> str:
    """Label of a vocabulary term: its alias label, else the title-cased term."""
    return SKILL_ALIASES.get(term, term.title())


def skill_terms() -> dict[str, str]:
    """Every term that is searched for, with the label it yields."""
    return {t: skill_label(t) for t in (*KNOWN_SKILLS, *SKILL_ALIASES)}


def is_word(term: str) -> bool:
    """True if the term is one run of word characters."""
    return all(c.isalnum() or c == "_" for c in term)


def components(term: str) -> list[str]:
    """The word tokens of a term."""
    return re.findall(r"\w+", term)


def bounded(term: str) -> str:
    """Regex for a term with Unicode word boundaries on both sides.

    A side that is itself no word character needs a word character as its
    neighbour: that is what a word boundary means there.
    """
    escaped = "".join(c if c.isalnum() or c == " " else "\\" + c for c in term)
    left = rf"(^|[^{WORD}])" if is_word(term[0]) else rf"[{WORD}]"
    right = rf"([^{WORD}]|$)" if is_word(term[-1]) else rf"[{WORD}]"
    return left + escaped + right
