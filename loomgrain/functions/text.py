"""Text functions as column expressions; Python only where Spark has none."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control characters except tab, line feed and carriage return.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"
# Secrets by name and pattern, in the order in which they are tried; the token families' own public formats.
SECRETS: dict[str, str] = {
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "github_ghp": r"ghp_[A-Za-z0-9_]{36,}",
    "github_gho": r"gho_[A-Za-z0-9_]{36,}",
    "github_ghu": r"ghu_[A-Za-z0-9_]{36,}",
    "github_ghs": r"ghs_[A-Za-z0-9_]{36,}",
    "google_api_key": r"AIza[0-9A-Za-z_-]{30,}",
    "sk_key": r"sk-[A-Za-z0-9]{20,}T3BlbkFJ",
    "sk_proj_key": r"sk-proj-[A-Za-z0-9]{48,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "assignment": r"(?:secret|password|token|api_key|apikey|access_key)\s*[:=]\s*[\"']?[A-Za-z0-9+/=_-]{20,}[\"']?",
}
#: A token of at least so many characters and so many bits a byte is taken for a secret.
LONG_TOKEN, SECRET_BITS = 20, 4.5


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def line_count(c: Column) -> Column:
    """Lines of a text: 0 for an empty one, and a closing line feed begins no further line."""
    body = F.regexp_replace(c, "\n$", "")
    return F.when(F.length(c) == 0, 0).otherwise(F.size(F.split(body, "\n")))


def char_trigrams(c: Column) -> Column:
    """Distinct runs of three characters; empty for shorter texts. The text is cut into characters once, so cost follows its length."""
    chars = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    # the outer lambda binds the characters, which would else be cut anew for each of them
    grams = F.transform(F.array(chars), lambda cs: F.transform(cs, lambda x, i: F.concat(x, F.get(cs, i + 1), F.get(cs, i + 2))))
    return F.array_distinct(F.filter(F.get(grams, F.lit(0)), lambda g: g.isNotNull()))


def code_words(c: Column) -> Column:
    """Words of code in lower case: split at signs, before capitals, and inside acronyms before the last capital."""
    parted = F.regexp_replace(F.regexp_replace(c, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.transform(F.regexp_extract_all(parted, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.lower)


def plain_words(c: Column) -> Column:
    """Distinct words at white space, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[ \t\n\r]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_estimate(c: Column, up: bool = True) -> Column:
    """A quarter of the bytes, rounded up or down."""
    n = F.octet_length(c)
    return (F.ceil(n / 4) if up else F.floor(n / 4)).cast("bigint")


def looks_like_regex(c: Column) -> Column:
    return F.rlike(c, F.lit(r"[\\^$*+?()\[\]{}|]"))


def looks_like_identifier(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^[A-Za-z_][A-Za-z0-9_]*([.:]+[A-Za-z_][A-Za-z0-9_]*)*$"))


def secret_kind(c: Column) -> Column:
    """Name of the first kind of secret in a text; null for none."""
    return F.coalesce(*(F.when(F.rlike(c, F.lit(p)), F.lit(name)) for name, p in SECRETS.items()))


def redact(c: Column) -> Column:
    """The text with each secret replaced by its kind."""
    for name, pattern in SECRETS.items():
        c = F.regexp_replace(c, pattern, f"[REDACTED:{name}]")
    return c


def truncate_bytes(c: Column, most: int) -> Column:
    """The longest prefix of whole characters of at most `most` bytes."""
    # a UTF-8 continuation byte is 10xxxxxx: the prefix may end before any byte that isn't one
    raw = F.encode(c, "UTF-8")
    byte = lambda at: F.conv(F.hex(F.substring(raw, at, 1)), 16, 10).cast("int")
    inside = lambda at: byte(at).between(128, 191)
    end = F.when(~inside(most + 1), most).when(~inside(most), most - 1).when(~inside(most - 1), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.decode(F.substring(raw, F.lit(1), end), "UTF-8"))


def sanitise(c: Column, most: int) -> Column:
    """The text without its secrets, cut to at most `most` bytes: redacted first, so that no cut leaves a part of a secret."""
    return truncate_bytes(redact(c), most)


def entropy(c: Column) -> Column:
    """Shannon entropy in bits over the characters of an ASCII text; 0 for an empty one."""
    n = F.length(c)
    chars = F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    share = lambda x: (n - F.length(F.replace(c, x, F.lit("")))) / n
    return F.aggregate(chars, F.lit(0.0), lambda acc, x: acc - share(x) * F.log2(share(x)))


def urn(namespace: str, kind: str, identifier: Column) -> Column:
    return F.concat(F.lit(f"urn:{namespace}:{kind}:"), F.replace(identifier, F.lit("\\"), F.lit("/")))


def urn_kind(c: Column) -> Column:
    return F.split_part(c, F.lit(":"), F.lit(3))


def age_days(c: Column) -> Column:
    """Days of an age such as 90d or 12w; null for anything else."""
    n, unit = F.regexp_extract(F.trim(c), r"^(\d{1,6})([dwDW])$", 1), F.lower(F.regexp_extract(F.trim(c), r"^(\d{1,6})([dwDW])$", 2))
    return F.when(n != "", n.cast("int") * F.when(unit == "w", 7).otherwise(1))


def staleness_tier(days: Column, threshold: int) -> Column:
    """null below the threshold, warning up to twice it, critical beyond."""
    return F.when(days < threshold, F.lit(None)).when(days <= 2 * threshold, "warning").when(days.isNotNull(), "critical")


def csv_field(c: Column) -> Column:
    """A field as CSV has it: quoted only where it holds a comma, a quote or a line end; null is empty."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(F.rlike(c, F.lit('[,"\r\n]')), quoted).otherwise(c), F.lit(""))


def path_role(c: Column) -> Column:
    """Role of a folder or file by the names on its path; the last name that tells counts most."""
    has = lambda names: F.rlike(F.lower(c), F.lit(rf"(^|/)({names})(/|$)"))
    return F.when(has("tests?|spec|__tests__"), "test").when(has("docs?|adr"), "documentation").when(has(r"\.github/workflows|deploy|infra|k8s|helm"), "infrastructure").when(has("config|settings|mappings"), "config").when(has("tools|scripts|bin"), "tooling").when(has("src|lib|crates|services|web|app"), "source").otherwise("unknown")


def manifest_type(c: Column) -> Column:
    """Kind of deployment manifest by path; null for other files."""
    low, name = F.lower(c), F.element_at(F.split(F.lower(c), "/"), -1)
    yaml = F.rlike(low, F.lit(r"\.ya?ml$"))
    return (
        F.when(~yaml & F.rlike(name, F.lit(r"^dockerfile(\..*)?$")), "dockerfile")
        .when(F.rlike(low, F.lit(r"\.tf(vars)?$")), "terraform")
        .when(yaml & F.startswith(name, F.lit("docker-compose")), "compose")
        .when(yaml & F.rlike(low, F.lit(r"/(k8s|kubernetes)/")), "kubernetes")
        .when(yaml & (F.contains(low, F.lit("/helm/")) | (name == "chart.yaml")), "helm")
        .when(yaml & F.contains(low, F.lit(".github/workflows/")), "workflow")
    )


def required_trigrams(pattern: str) -> list[str]:
    """Trigrams that every match of a regular expression holds; none where that isn't certain.

    Only plain characters outside of groups, classes and repetitions count, and an alternation gives
    none, so that a filter by them never loses a match.
    """
    if "|" in pattern or "(?" in pattern:
        return []
    runs, run, i, depth = [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        plain = c not in r".^$*+?{}[]\|()"
        if c == "\\":
            i += 1
            escaped = pattern[i : i + 1]
            c, plain = escaped, bool(escaped) and not escaped.isalnum()
        elif c == "[":
            end = pattern.find("]", i + 2)
            i = len(pattern) if end < 0 else end
        elif c == "{":
            end = pattern.find("}", i)
            i = len(pattern) if end < 0 else end
        elif c in "()":
            depth += 1 if c == "(" else -1
        i += 1
        repeated = pattern[i : i + 1] in ("*", "?", "{", "+")
        if plain and depth == 0 and not repeated:
            run += c
        else:
            runs.append(run)
            run = ""
    runs.append(run)
    return sorted({r[k : k + 3] for r in runs for k in range(len(r) - 2)})


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition of a text."""
    return texts.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t))


def osa_distance(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance: insertions, deletions, substitutions, transpositions of neighbours; most + 1 beyond."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def fuzzy_distance(query: str, most: int = 2):
    """A pandas UDF: distance of each word from query, most + 1 beyond."""

    @F.pandas_udf(T.IntegerType())
    def distance(words: pd.Series) -> pd.Series:
        return words.map(lambda w: most + 1 if w is None else osa_distance(query, w, most))

    return distance


_HEADING = re.compile(r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")


def markdown_chunks(text: str, most: int = 512, overlap: int = 64, least: int = 50) -> list[tuple[str | None, str]]:
    """(heading, content) of a Markdown text, cut at headings and, where a section is too long, at paragraphs.

    Sizes are estimated tokens, a quarter of the bytes rounded up. A section below `least` joins the one
    before it. A long section's pieces repeat the paragraphs at the end of the piece before, up to
    `overlap`. A paragraph longer than `most` stays whole. Headings inside code fences aren't headings.
    """
    size = lambda t: -(-len(t.encode()) // 4)
    sections: list[tuple[str | None, list[str]]] = [(None, [])]
    fenced = False
    for line in text.splitlines():
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        m = None if fenced else _HEADING.match(line)
        if m:
            sections.append((m[2], []))
        else:
            sections[-1][1].append(line)
    joined: list[tuple[str | None, str]] = []
    for heading, lines in sections:
        body = "\n".join(lines).strip("\n")
        if not body.strip() and heading is None:
            continue
        if joined and size(body) < least:
            joined[-1] = (joined[-1][0], "\n\n".join(x for x in (joined[-1][1], heading, body) if x))
        else:
            joined.append((heading, body))
    out: list[tuple[str | None, str]] = []
    for heading, body in joined:
        if size(body) <= most:
            out.append((heading, body))
            continue
        piece: list[str] = []
        fresh = False
        for paragraph in re.split(r"\n[ \t]*\n+", body):
            if piece and fresh and size("\n\n".join([*piece, paragraph])) > most:
                out.append((heading, "\n\n".join(piece)))
                kept: list[str] = []
                for p in reversed(piece):
                    if size("\n\n".join([p, *kept])) > overlap:
                        break
                    kept.insert(0, p)
                piece, fresh = kept, False
            piece.append(paragraph)
            fresh = True
        if fresh:
            out.append((heading, "\n\n".join(piece)))
    return out
