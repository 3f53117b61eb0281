"""Keys, aliases and parts of technology names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Renames between survey years (in the vocabulary, in trends), answers that
# are no technology, prefixes of vendors, extra aliases by key, aliases too general to keep,
# and names shown otherwise.
VOCABULARY_RENAMES = {
    "amazonwebservices": "aws",
    "googlecloudplatform": "googlecloud",
    "linodenowakamai": "linode",
    "ibmcloudorwatson": "ibmcloud",
    "jupyternb/jupyterlab": "jupyternotebook/jupyterlab",
    "ipython/jupyter": "jupyternotebook/jupyterlab",
    "windowssubsystemforlinux": "wsl",
    "linuxnonwsl": "linux",
    "linuxbased": "linux",
    "otherlinuxbased": "linux",
    "visualstudiocode": "vscode",
}
TREND_RENAMES = {
    "amazonwebservices": "aws",
    "googlecloudplatform": "googlecloud",
    "microsoftazure": "azure",
    "linodenowakamai": "linode",
    "ibmcloudorwatson": "ibmcloud",
    "jupyternb/jupyterlab": "jupyter",
    "jupyternotebook/jupyterlab": "jupyter",
    "ipython/jupyter": "jupyter",
    "windowssubsystemforlinux": "wsl",
    "linuxnonwsl": "linux",
    "otherlinuxbased": "linux",
    "linuxbased": "linux",
    "visualstudiocode": "vscode",
    "bash/shell/powershell": "bash/shell",
    "torch/pytorch": "pytorch",
    "reactjs": "react",
    "vuejs": "vue",
    "nodejs": "node.js",
    "angularjs": "angular.js",
}
NO_ANSWER = r"(?i)^(other|none|i don'?t use|not sure|unsure|indifferent|favorable|unfavorable|very favorable|very unfavorable|n/?a)\b"
VENDORS = ("apache ", "microsoft ", "google ", "amazon ", "ibm ", "oracle ", "gnu ", "the ", "adobe ", "atlassian ")
EXTRA_ALIASES = {
    "googlecloud": ("GCP", "Google Cloud Platform"),
    "aws": ("AWS", "Amazon AWS"),
    "microsoftazure": ("Azure", "MS Azure"),
    "kubernetes": ("K8s",),
    "postgresql": ("Postgres",),
    "javascript": ("JS",),
    "typescript": ("TS",),
    "microsoftsqlserver": ("SQL Server", "MSSQL", "T-SQL"),
    "vscode": ("VS Code", "VSCode"),
    "jupyternotebook/jupyterlab": ("Jupyter", "Jupyter Notebook", "JupyterLab"),
    "html/css": ("HTML", "CSS"),
    "bash/shell": ("Bash", "Shell", "Shell Scripting", "Shell scripting"),
    "node.js": ("Node", "NodeJS"),
    "c#": ("CSharp", "C Sharp"),
    ".net": ("dotnet", ".NET Core"),
    "reactjs": ("React", "React.js"),
    "angular": ("AngularJS", "Angular.js"),
    "vue.js": ("Vue", "VueJS"),
    "linux": ("Linux",),
    "macos": ("Mac OS", "Mac OS X", "OSX"),
    "objectivec": ("Objective C",),
    "ruby": ("Ruby on Rails",),
}
TOO_GENERAL = (
    "meet", "teams", "chat", "office", "word", "excel", "access", "one", "now", "cloud", "code", "test", "build",
    "make", "go", "r", "c", "spaces", "drive", "docs", "notes", "mail", "calendar", "search", "assistant", "studio",
    "core", "framework", "server", "web services", "services", "platform", "engine",
)
SHOWN_AS = {
    "Linux (non-WSL)": "Linux",
    "Amazon Web Services (AWS)": "AWS",
    "Bash/Shell (all shells)": "Bash/Shell",
    "Slack (public)": "Slack",
    ".NET (5+)": ".NET",
    ".NET Framework (1.0 - 4.8)": ".NET Framework",
    "APIs": "API",
}


def normalize(name: Column) -> Column:
    """Key of a name: lower case, bracketed parts dropped, & as and, only a-z 0-9 + # . / kept."""
    x = F.regexp_replace(F.lower(name), r"\(.*?\)", " ")
    x = F.regexp_replace(F.replace(x, F.lit("&"), F.lit(" and ")), r"[^a-z0-9+#./]", "")
    return F.regexp_replace(x, r"\.+$", "")


def _lookup(c: Column, table: dict) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), c)


def renamed(key: Column, table: dict[str, str]) -> Column:
    return _lookup(key, table)


def canon_key(name: Column) -> Column:
    """Key under which a technology keeps one series over renames."""
    return renamed(normalize(name), TREND_RENAMES)


def display_name(name: Column) -> Column:
    return _lookup(name, SHOWN_AS)


def is_no_answer(name: Column) -> Column:
    return name.rlike(NO_ANSWER)


def without_brackets(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\(.*?\)", ""))


def slash_parts(name: Column) -> Column:
    """Parts of a compound such as A/B; none for names that begin with a dot."""
    bare = without_brackets(name)
    parts = F.filter(F.transform(F.split(bare, "/"), F.trim), lambda x: F.length(x) > 1)
    return F.when(bare.contains("/") & ~bare.startswith("."), parts).otherwise(F.array().cast("array<string>"))


def vocabulary_key(name: Column) -> Column:
    """Key of a name in the vocabulary, under which its extra aliases stand."""
    return renamed(normalize(name), VOCABULARY_RENAMES)


def aliases(name: Column, key: Column) -> Column:
    """Other spellings under which a name is looked up, sorted; ``key`` as of :func:`vocabulary_key`."""
    bare, low = without_brackets(name), F.lower(name)
    cut = F.array(*[F.when(low.startswith(v), F.trim(F.substring(name, len(v) + 1, 1 << 20))) for v in VENDORS])
    made = F.array_union(F.array_union(F.array(bare), cut), slash_parts(name))
    made = F.filter(made, lambda x: x.isNotNull() & (F.length(x) > 1) & ~F.lower(x).isin(*TOO_GENERAL))
    extra = F.create_map(*[y for k, v in EXTRA_ALIASES.items() for y in (F.lit(k), F.array(*map(F.lit, v)))])
    made = F.array_union(made, F.coalesce(F.element_at(extra, key), F.array().cast("array<string>")))
    return F.array_sort(F.array_remove(made, name))
