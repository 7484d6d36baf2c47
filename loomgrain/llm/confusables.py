"""Visually identical text with different characters (problem 1).

A text is brought to one form: compatibility and width forms are folded, marks are composed, and invisible
characters are dropped. Then each token's script sets are
intersected. An empty intersection is a mixed-script token, one whose letters all look like letters of
another script is a whole-script confusable; both are spelled in the first script that can spell the
whole token. The result depends on the letters' looks only, so texts that look alike get the same form.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.cluster import broadcast_if

# Letters that look alike, after Unicode's public confusables data (UTS 39), in an order by which the usual one
# comes first; all further letters of that data are added by public_groups(). In each group the first letter stands for all where no script can spell a token. Letters of unlike looks, of other case, or told
# apart by a dot or a stroke aren't together.
LOOK_ALIKES = """
aаɑα  bЬƅᏏ  cсϲᴄⲥ  dԁᏧ  eеҽ℮  fքꞙ  gɡցᶃ  hһհᏂ  iіιɩᎥꙇ  jјϳ  lӏǀⵏ  nոռ  oоοօᴏⲟჿ  pрρⲣ  qԛգ  rⲅ
sѕꜱ  uսυʋᴜ  vνѵᴠ  wԝաᴡ  xхᕁ  yуүʏγყ  zᴢ
AАΑᎪ  BВΒᏴ  CСϹᏟ  DᎠ  EЕΕᎬ  FϜ  GԌᏀ  HНΗᎻ  IІΙӀ  JЈᎫ  KКΚᏦ  LᏞ  MМΜᎷ  NΝⲚ  OОΟՕ  PРΡᏢ  QԚ  SЅՏᏚ  TТΤᎢ
UՍ  VѴᏙ  WԜᎳ  XХΧ  YΥҮ  ZΖᏃ
кκĸ  гᴦ  вʙ  нʜ  мᴍ  тᴛ  ΓГ  ΠП  ΦФ  ɛε  əә  þϸ
"""
# Signs that look alike; the first stands for all.
SIGNS = """
/⁄∕⧸  .․  -‐‑‒–−⁃˗  :∶꞉ː  '’‘ʼʹ′ˈ  ,‚  ~∼˜  *∗  |∣  ;;  !ǃ  _ˍ
"""
# The scripts in the order in which a token's spelling is tried.
SCRIPTS = """
Latin Cyrillic Greek Armenian Georgian Cherokee Coptic Hebrew Arabic Devanagari Bengali Tamil Telugu Thai Lao Ethiopic
Khmer Myanmar Hangul Hiragana Katakana Bopomofo Han Tifinagh Lisu Canadian_Aboriginal Glagolitic Gothic Deseret
""".split()
#: A writing system is a set of scripts that stand together by rule.
_SYSTEMS = {"Han": ("Han with Bopomofo", "Japanese", "Korean"), "Hiragana": ("Japanese",), "Katakana": ("Japanese",), "Hangul": ("Korean",), "Bopomofo": ("Han with Bopomofo",)}
_FOLDED = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
_LIGATURE = regex.compile(r"[ﬀ-ﬆĲĳǇ-ǌǱ-ǳⅠ-ⅿ…‥]")
_SPACE = regex.compile(r"\p{Zs}")
#: Ignorable characters, joiners included, are dropped as in the public skeleton of UTS 39; overrides and embeddings from right to left reorder what is seen and stay.
_INVISIBLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\ufff9-\ufffb\u00ad--[\u202b\u202e\u2067\u115f\u1160\u3164\uffa0]]", regex.VERSION1)
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{Nd}\p{Nl}]+")
#: Letters that the public data join but that a reader can tell apart, by a missing dot or their size.
NOT_ALIKE = "ıɪ"
#: Signs that stand for those that look like them.
PLAIN_SIGNS = "/\\-.,:*~_!<>="
#: Scripts whose letters, without case, have the size of capitals.
_UNICASE = regex.compile(r"[\p{Script=Lisu}\p{Script=Carian}\p{Script=Lycian}\p{Script=Lydian}\p{Script=Old_Italic}\p{Script=Runic}]")


_SCRIPT_TESTS = {s: regex.compile(rf"\p{{scx={s}}}") for s in SCRIPTS}
_SHARED = regex.compile(r"[\p{Script=Common}\p{Script=Inherited}]")


@lru_cache(maxsize=65536)
def script_set(c: str) -> frozenset[str] | None:
    """The writing systems in which c is used; None for all of them."""
    scripts = [s for s, test in _SCRIPT_TESTS.items() if test.match(c)]
    if not scripts:
        return None if _SHARED.match(c) else frozenset(["other"])
    return frozenset(x for s in scripts for x in _SYSTEMS.get(s, (s,)))


def resolved_scripts(token: str) -> frozenset[str] | None:
    """The intersection of the script sets of a token's letters; None for all, empty for a mixed token."""
    out: frozenset[str] | None = None
    for c in token:
        own = script_set(c)
        if own is not None:
            out = own if out is None else out & own
    return out


def _groups(text: str) -> list[str]:
    return text.split()


class Looks:
    """What looks alike: each letter's group, whose first member stands for all where no script can spell a token, and each sign's first."""

    def __init__(self, groups: Iterable[str], signs: Iterable[str]) -> None:
        self.alike: dict[str, str] = {}
        for group in groups:
            whole = "".join(dict.fromkeys(x for c in group for x in self.alike.get(c, c)))
            for c in whole:
                self.alike[c] = whole
        self.sign = {c: g[0] for g in signs for c in g}
        self.spelled: dict[tuple[str, str], str | None] = {}
        self.folded: dict[str, str] = {}

    def in_system(self, c: str, system: str) -> str | None:
        """The spelling of c, or of a letter that looks like it, in a writing system; of several the first."""
        key = (c, system)
        if key not in self.spelled:
            sets = ((x, script_set(x)) for x in self.alike.get(c, c))
            self.spelled[key] = next((x for x, own in sets if own is None or system in own), None)
        return self.spelled[key]

    def fold(self, c: str) -> str:
        """c without its width and font form, in single characters and marks, signs by the one that stands for them."""
        known = self.folded.get(c)
        if known is None:
            form = unicodedata.decomposition(c)
            plain = unicodedata.normalize("NFKD", c) if form.startswith(_FOLDED) or _LIGATURE.match(c) or (form.startswith("<compat>") and _SPACE.match(c)) else c
            known = self.folded[c] = "".join(" " if _SPACE.match(x) else self.sign.get(x, x) for x in unicodedata.normalize("NFD", plain))
        return known


#: The letters and signs listed above.
LISTED = Looks(_groups(LOOK_ALIKES), _groups(SIGNS))


def skeletons(spark: SparkSession) -> dict[str, str]:
    """Each letter, number and sign whose public skeleton (UTS 39) is another single character, with that character.

    The data are those of the ICU library that Spark itself brings; all characters are asked for at once, on the driver.
    """
    jvm = spark.sparkContext._jvm
    checker = getattr(jvm, "com.ibm.icu.text.SpoofChecker$Builder")().build()
    asked = [c for c in map(chr, range(0x21, sys.maxunicode + 1)) if unicodedata.category(c)[0] in "LNPS" and unicodedata.normalize("NFD", c) == c]
    return {c: s for c, s in zip(asked, checker.getSkeleton("\n".join(asked)).split("\n"), strict=True) if len(s) == 1 and s != c}


def public_groups(skeleton: dict[str, str]) -> tuple[list[str], list[str]]:
    """Groups of letters and of signs that look alike, by the listed ones and by the public skeletons.

    The public data also join what a reader can tell apart; there these rules hold: a listed letter stays in its
    group; letters don't join digits; among l, I, 1 and | capitals and letters of scripts without case are I and others l;
    among O and 0 digits are 0 and others O; of a letter in both cases the small one stays. Letters of NOT_ALIKE join nothing.
    """
    classes: dict[str, list[str]] = {}
    for c, s in skeleton.items():
        kind = unicodedata.category(c)
        if c.isascii() or c in LISTED.alike or c in NOT_ALIKE or kind in ("Lm", "No") or kind[0] not in "LN":
            continue
        if LISTED.fold(c) != c or (kind != "Nd" and _SHARED.match(c)):
            continue  # a form that is folded by itself, or a letter of no script
        if s == "l":
            s = "I" if kind == "Lu" or _UNICASE.match(c) else "l"
        elif s == "O" and kind == "Nd":
            s = "0"
        elif s.isascii() and (s.isdigit() != (kind == "Nd")) and not (s.isalpha() and kind == "Nd"):
            continue
        classes.setdefault(s, []).append(c)
    letters = list(_groups(LOOK_ALIKES))
    for s, members in classes.items():
        group = LISTED.alike.get(s, s)
        if unicodedata.category(s)[0] in "LN":
            whole = set(group) | set(members)
            letters.append(group + "".join(c for c in sorted(members) if not (c.lower() != c and c.lower() in whole)))
    signs = {g[0]: g for g in _groups(SIGNS)}
    for c, s in sorted(skeleton.items()):
        if s in PLAIN_SIGNS and unicodedata.category(c)[0] in "PS" and c not in LISTED.sign:
            signs[s] = signs.get(s, s) + c
    return letters, list(signs.values())


_ORDER = list(dict.fromkeys(x for s in SCRIPTS for x in _SYSTEMS.get(s, (s,))))


def consistent_spelling(token: str, looks: Looks = LISTED) -> tuple[str, str]:
    """The token in the first writing system that can spell it whole, and what it was: 'plain', 'mixed', 'whole' or 'unresolved'."""
    scripts = resolved_scripts(token)
    if scripts is None:
        return token, "plain"
    for system in _ORDER:
        letters = [looks.in_system(c, system) for c in token]
        if None not in letters:
            spelled = "".join(letters)
            return spelled, "plain" if spelled == token else "mixed" if not scripts else "whole"
    spelled = "".join(looks.alike.get(c, c)[0] for c in token)
    return spelled, "unresolved" if not scripts else "plain"


def visible_form(text: str, looks: Looks = LISTED) -> str:
    """text in the one form that all texts of the same look share. White space at either end isn't seen."""
    if text.isascii():
        return text.strip(" ")
    bare = _INVISIBLE.sub("", text)
    folded = unicodedata.normalize("NFD", "".join(map(looks.fold, bare)))
    spelled = _TOKEN.sub(lambda m: consistent_spelling(m[0], looks)[0], folded)
    return unicodedata.normalize("NFC", spelled).strip(" ")


_LOOKS: list[tuple[tuple[list[str], list[str]], Looks]] = []


def _shared_looks(groups: tuple[list[str], list[str]]) -> Looks:
    """The looks of broadcast groups, made once in a worker process."""
    if not _LOOKS or _LOOKS[0][0] is not groups:
        _LOOKS[:] = [(groups, Looks(*groups))]
    return _LOOKS[0][1]


_PUBLIC: dict[str, Broadcast] = {}


def public_looks(spark: SparkSession) -> Broadcast:
    """The groups of the public data, broadcast once in an application: some thousand characters, whatever the tables."""
    app = spark.sparkContext.applicationId
    if app not in _PUBLIC:
        _PUBLIC.clear()
        _PUBLIC[app] = spark.sparkContext.broadcast(public_groups(skeletons(spark)))
    return _PUBLIC[app]


def normalize_text(df: DataFrame, column: str, to: str) -> DataFrame:
    """df with the visible form of a text column in column `to`; null stays null. No row is dropped or moved."""

    shared = public_looks(df.sparkSession)

    @F.pandas_udf("string")
    def form(texts):
        looks = _shared_looks(shared.value)
        known: dict[str, str] = {}
        return texts.map(lambda t: None if t is None else known[t] if t in known else known.setdefault(t, visible_form(t, looks)))

    return df.withColumn(to, form(F.col(column).cast("string")))


def same_look(values: DataFrame, value: str, names: DataFrame, name_id: str, name: str) -> DataFrame:
    """Rows of values whose text is none of the names but looks like one, each with that name's id as __name_id.

    Names are unique texts; several may look alike, then each of them comes out. Null values are no cases.
    The names are broadcast where their counted number allows it, so that values never move and a
    frequent value is no hot key; else both joins shuffle and adaptive execution splits hot keys.
    """
    known = names.select(F.col(name_id).alias("__name_id"), F.col(name).cast("string").alias("__name")).filter("__name is not null").distinct()
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("__name")), F.lit(0))).first()
    texts = broadcast_if(known.select(F.col("__name").alias("__exact")).distinct(), n, size=size)
    odd = values.filter(F.col(value).isNotNull()).join(texts, F.col(value) == F.col("__exact"), "left_anti")
    forms = broadcast_if(normalize_text(known, "__name", "__form").select("__name_id", "__form"), n, size=size)
    return normalize_text(odd, value, "__look").join(forms, F.col("__look") == F.col("__form")).drop("__look", "__form")


def spelled_files(transactions: DataFrame, files: DataFrame) -> DataFrame:
    """tx_id, field_name, file_id of every transaction's field that shows a file's path in other characters."""
    fields = ["entity", "entity_normalized"]
    long = transactions.select("tx_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("shown")) for f in fields))).alias("x")).select("tx_id", "x.field_name", "x.shown")
    found = same_look(long, "shown", files, "id", "file_path")
    return found.select("tx_id", "field_name", F.col("__name_id").cast("bigint").alias("file_id")).distinct()


def token_report(text: str, looks: Looks = LISTED) -> list[tuple[str, str, str]]:
    """(token, spelling, kind) of each token that isn't plain, after folding of forms."""
    folded = unicodedata.normalize("NFD", "".join(map(looks.fold, _INVISIBLE.sub("", text))))
    out = []
    for m in _TOKEN.finditer(folded):
        spelled, kind = consistent_spelling(m[0], looks)
        if kind != "plain":
            out.append((m[0], spelled, kind))
    return out
