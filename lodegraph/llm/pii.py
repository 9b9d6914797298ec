"""Personal information inside free text: mentions, and surrogates in their place.

E-mail addresses, phone, identity numbers and street addresses are recognised by
their formats and the words around them.  A person's name is a run of
capitalised words; whether it is one is decided by statistics over the whole
corpus: how often its words are written small elsewhere, and how often they
stand where names stand (after "reviewed by", before an address in angle
brackets).  Surrogates are keyed: one entity gets one replacement everywhere, of
its own type, script and format, and two entities never share one.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodegraph.runtime import materialize, release, ship, union_all

EMAIL = regex.compile(r"(?<![\p{L}\p{N}._%+@/:-])(?!git@)[\p{L}\p{N}][\p{L}\p{N}\p{M}._%+'-]*@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?\.)+\p{L}{2,}(?![\p{L}\p{N}@-]|:[\p{L}\p{N}/~])")
_DOT = r"(?:\s?[\[({]\s?(?:dot|punto|point|punkt)\s?[\])}]\s?|\s(?:dot|punto|point|punkt)\s)"
#: What an address written out has from its "at" on, and what stands before it.
VEILED = regex.compile(
    r"(?i)\s?[\[({]\s?(?:at|arroba|arobase|ät|@)\s?[\])}]\s?[\p{L}\p{N}-]+(?:(?:\.|" + _DOT + r")[\p{L}\p{N}-]+)+"
    r"|\s(?:at|arroba|arobase|ät)\s[\p{L}\p{N}-]+(?:" + _DOT + r"[\p{L}\p{N}-]+)+"
)
VEILED_NAME = regex.compile(r"(?i)(?<![\p{L}\p{N}._%+@/:-])[\p{L}\p{N}][\p{L}\p{N}._%+'-]*(?:" + _DOT + r"[\p{L}\p{N}._%+'-]+)*$")
EXT = r"(?:\s*(?:ext\.?|x|Durchwahl|poste|extensión)\s*\d{1,6})?"
PHONE = regex.compile(
    r"(?<![\p{L}\p{N}.,:/#@_+-])(?:"
    r"\+[1-9]\d{0,2}(?:[ .-]?\(0?\d{1,4}\))?(?:[ .-]?\d{1,6}){2,6}"
    r"|00[1-9]\d{0,2}[ .-]\d{1,5}(?:[ .-]\d{1,7}){1,4}"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|1-\d{3}-\d{3}-\d{4}"
    r"|\(0\d{1,4}\) ?\d{2,8}(?:[ -]\d{2,6}){0,3}|0\d{2,4}/\d{5,9}(?:-\d{1,4})?"
    r"|0[1-9](?:[ .-]\d{2}){4}|0\d{2,4} \d{3,4} \d{3,4}|0\d{4} \d{6}"
    r"|[6789]\d{2}[ -]\d{3}[ -]\d{3}|[6789]\d{2}(?: \d{2}){3}"
    r")(?![\p{L}\p{N}_]|[.,:/-]\d|@)" + EXT
)
CALLED = regex.compile(
    r"(?i)\b(?:call|phone|tel|tél|telefon|telefonisch(?: erreichbar)?(?: unter)?|mobile?|móvil|handy|fax|hotline|reach (?:me|us|him|her|them)(?: (?:under|at|on))?|ring|bereitschaft|appeler|llamar|teléfono|téléphone|whatsapp|sms)"
    r"(?:[.:]|\s+(?:al|le|au|under|at|on|unter|me|us|number|is|:))*\s*(\(?\+?\d[\d ()./-]{5,18}\d)(?![\p{L}\p{N}])"
)
#: Shapes that are identity numbers without a word beside them.
BARE_ID = regex.compile(
    r"(?<![\p{L}\p{N}.,:/#@_+-])(?:\d{3}-\d{2}-\d{4}|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|\d{2} ?\d{6} ?\p{Lu} ?\d{3}|[1-478] ?\d{2} ?(?:0[1-9]|1[0-2]|[2-9]\d) ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3} ?\d{2}|\d{8}-?[A-HJ-NP-TV-Z]|[XYZ]-?\d{7}-?[A-HJ-NP-TV-Z])(?![\p{L}\p{N}_]|[.,:/-]\d)"
)
#: What identity numbers are called.
ID_NAME = (
    r"passport|passeport|pasaporte|reisepass|pass-?nr|driv(?:er|ing)(?:['’]?s)? licen[cs]e|licen[cs]e (?:no|number|nr)|führerschein|permis de conduire|carnet de conducir|permiso de conducir"
    r"|ssn|social security|national insurance|nino|insurance (?:no|number)|tax (?:id|no|number|file)|tin|itin|ein|vat id|national id|identity card|id card|id[- ]?number"
    r"|steuer-?id(?:entifikationsnummer|nr)?|steuernummer|personalausweis|ausweis(?:nummer|nr)?|sozialversicherungs?(?:nummer|nr)?|versicherten?nummer|krankenversicherung|rentenversicherung"
    r"|numéro de sécu(?:rité sociale)?|sécurité sociale|numéro fiscal|carte d['’]identité|cni|nir|nif|nie|dni|seguridad social|número de afiliación|nss|cif"
)
#: How those names, and words beside phone numbers, begin.
ID_STARTS = (
    "passport passeport pasaporte reisepass passnr pass-nr driv licen führerschein permis carnet ssn social national insurance nino tax tin itin ein vat identity "
    "id steuer personalausweis ausweis sozialversicherung versicherte krankenversicherung rentenversicherung numéro sécurité carte cni nir nif nie dni seguridad número nss cif"
).split()
CALL_STARTS = "call phone tel tél mobil móvil handy fax hotline reach ring bereitschaft appeler llamar whatsapp sms".split()
NAMED_ID = regex.compile(
    r"(?i:(?<![\p{L}\p{N}_-])(?:" + ID_NAME + r"))(?:\s*(?:no|nr|num|number|nummer|numéro|número|n[°º])?[.:#]*\s*(?:is|ist|est|es|=)?\s*)"
    r"((?=[\p{Lu}\d .-]{0,6}\d)[\p{Lu}\d](?:[ .-]?[\p{Lu}\d]){5,24})(?![\p{L}\p{N}])"
)
STREET_EN = r"(?:Street|Avenue|Road|Lane|Drive|Court|Way|Close|Square|Terrace|Place|Boulevard|Crescent|Row|Alley|Parkway|Highway|Hill|Mews|St\.?|Ave\.?|Rd\.?|Ln\.?|Dr\.?|Blvd\.?|Ct\.?)"
ADDRESS = regex.compile(
    r"(?<![\p{L}\p{N}.,:/#@_-])(?:"
    r"\d{1,5}[A-Za-z]?(?:[-/]\d{1,4})?,? (?:(?:\p{Lu}[\p{L}\p{M}'’-]+|Of|of|the) ){1,3}" + STREET_EN + r"(?![\p{L}\p{N}])(?! (?!Apt|Suite|Unit|Flat|Floor|Bldg|North|South|East|West)\p{Lu}[\p{Ll}]+s?\b(?<! (?:Call|Mail|Owner|Reviewed|Thanks|Contact|The|On|You|Ship|Her|Invoice|Record|Onboarding|Status|Rule|After|Every|Docs|Hot|Open|Please|Nothing|Drift|Compression|Ingestion|Reviewers|We|Clone|Install|Ticket|Job|Trace|ADR|Incident|In|It|A|An|And|See|At|For|From|To|This|That|If|When)))"
    r"|\p{Lu}[\p{L}\p{M}-]*(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|damm|ufer|stieg|pfad|markt|chaussee)\s+\d{1,4}\s?[a-z]?(?![\p{L}\p{N}])"
    r"|(?:Am|An der|Im|In der|Auf dem|Zum|Zur|Unter den) \p{Lu}[\p{L}\p{M}-]+ \d{1,4}[a-z]?(?=, (?:\d{5} )?\p{Lu}| in \p{Lu}\p{Ll}+(?:-\p{Lu}|[.\s]*$|[.]))"
    r"|\d{1,4}(?:[A-Za-z]| ?bis| ?ter)?,? (?:[Rr]ue|[Aa]venue|[Aa]v\.|[Bb]oulevard|[Bb]d\.?|[Aa]llées?|[Pp]lace|[Cc]hemin|[Ii]mpasse|[Qq]uai|[Rr]oute|[Cc]ours|[Ss]quare|[Pp]assage|[Ss]entier)(?: (?:de la|de l['’]|des|de|du|d['’]|la|le|les))? ?\p{Lu}[\p{L}\p{M}'’-]+"
    r"|\d{1,4}(?:[A-Za-z]| ?bis| ?ter)?,? (?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Aa]llées?|[Cc]hemin|[Ii]mpasse|[Qq]uai) (?:de la |de l['’]|des |de |du |d['’])?\p{L}[\p{L}\p{M}'’-]+"
    r"|(?:[Cc]alle|C/|[Aa]venida|[Aa]vda\.?|[Pp]aseo|[Pp]laza|[Cc]amino|[Rr]onda|[Cc]arretera|[Tt]ravesía|[Cc]allejón) ?(?:(?:de la|de las|de los|del|de|la|las|los|el) )?\p{L}[\p{L}\p{M}'’-]+(?: (?:(?:de la|de|del) )?\p{Lu}[\p{L}\p{M}'’-]+){0,3},? (?:n\.?[º°]? ?|núm\.? ?)?\d{1,4}(?![\p{L}\p{N}]|\.\d)"
    r")"
)
#: Words before or after a number that make it no identity number.
NO_ID_BEFORE = regex.compile(r"(?i)\b(?:range|code|ref(?:erence)?|order|part|ticket|issue|layer|job|build|batch|trace|version|lot|sku|series|row|line|port|id range|bereich|auftrag|zeile|plage|ligne|commande|rango|línea|pedido|lote)s?[\s:#.]*$")
NO_ID_AFTER = regex.compile(r"(?i)^\s*(?:is|ist|est|es)\s+(?:an?|the|eine?|une?|una?|der|die|das|le|la|el)\s+(?:[\p{L}-]+\s+){0,2}(?:code|range|key|version|layer|port|bereich|schlüssel|plage|clé|rango|clave|código)\b")
CAP = r"\p{Lu}[\p{Ll}\p{M}’']+(?:\p{Lu}[\p{Ll}\p{M}]+)?"
INITIAL = r"\p{Lu}\."
GAP = r"(?:[ \t ]+|[ \t]*\n[>#*/ \t]*)"
PARTICLE = r"(?:(?:van der|van den|van de|van|von der|von|zu|de la|de los|de|del|della|da|di|dos|la|le|der|den|ten|ter|af|bin|ibn|al|el|O)" + GAP + r")?"
FULL = regex.compile(rf"(?<![\p{{L}}\p{{N}}_@./#-])({CAP}(?:-{CAP})?){GAP}(?:{INITIAL}{GAP}?)*{PARTICLE}({CAP}(?:-{CAP})?)(?![\p{{L}}\p{{N}}_@(/=]|\.\p{{L}})")
SHORT = regex.compile(rf"(?<![\p{{L}}\p{{N}}_@./#-])({INITIAL})(?:{GAP}?{INITIAL})*{GAP}?{PARTICLE}({CAP}(?:-{CAP})?)(?![\p{{L}}\p{{N}}_@(/=]|\.\p{{L}})")
TURNED = regex.compile(rf"(?<![\p{{L}}\p{{N}}_@./#-])({CAP}(?:-{CAP})?),[ \t]+({CAP}(?:-{CAP})?)(?:[ \t]+{INITIAL})*(?![\p{{L}}\p{{N}}_@(/=-]|\.\p{{L}})")
LOUD = regex.compile(r"(?<![\p{L}\p{N}_@./#-])(\p{Lu}[\p{Lu}\p{M}’']+(?:-\p{Lu}{2,})?)[ \t]+(?:\p{Lu}\.[ \t]+)*(\p{Lu}[\p{Lu}\p{M}’']+(?:-\p{Lu}{2,})?)(?![\p{L}\p{N}_@(/=]|\.\p{L})")
#: Words after which, or before which, a person is named.
BEFORE = regex.compile(
    r"(?i)(?:\b(?:review(?:ed|er)?s?(?: by|:)|approved by|written by|signed[- ]off[- ]by:?|reported by|fixed by|assigned to|thanks to|credits? to|owners?:|authors?:|assignee:|contact:|cc:?|attn:?|dear|hi|hello|mr\.?|mrs\.?|ms\.?|dr\.?|from:|to:|name:|ask|ping|by"
    r"|zuständig ist|geprüft von|gemeldet von|erstellt von|ansprechpartner(?:in)?:?|(?:viele |liebe |mit freundlichen )?gr(?:uß|üße|üßen),?|dank an|danke an|an|frau|herr|liebe[r]?"
    r"|relu par|validé par|écrit par|merci à|cordialement,?|responsable\s?:|bonjour|madame|monsieur|écrire à|par"
    r"|revisado por|aprobado por|escrito por|gracias a|saludos,?|responsable:|estimad[oa]|señora?|escribir a|por)|--|—|–)\s*[:,]?\s*$"
)
AFTER = regex.compile(r"^\s*(?:<[^<>\n]{3,80}>|(?:asked|wrote|said|reviewed|fixed|reported|suggested|approved|owns|joined|left|will|has|a (?:corrigé|relu|demandé|écrit|signalé)|ha (?:corregido|pedido|escrito)|pidió|corrigió|revisó|hat|bittet|schrieb|fragt)\b)")
#: Openings that are followed by a comma and a first name.
SALUTATIONS = set("gruß grüße gruss hallo hello hi dear liebe lieber thanks merci gracias saludos cordialement bonjour hola regards best cheers salut".split())


def _line(starts: list[int], at: int) -> int:
    return bisect.bisect_right(starts, at)


_starts: dict[str, ahocorasick.Automaton] = {}


def _from_words(pattern: regex.Pattern, what: str, words: list[str], text: str, low: str) -> Iterator[regex.Match]:
    """Matches of a pattern that begins with one of ``words``, in order, none inside another."""
    if len(low) != len(text):  # a letter whose small form is longer
        yield from pattern.finditer(text)
        return
    if what not in _starts:
        a = ahocorasick.Automaton()
        for w in words:
            a.add_word(w, len(w))
        a.make_automaton()
        _starts[what] = a
    last = 0
    for at in sorted({end - n + 1 for end, n in _starts[what].iter(low)}):
        if at >= last and (m := pattern.match(text, at)):
            yield m
            last = m.end()


def _name_rows(text: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, first word, last word, stands where names stand) of everything that may be a name."""
    taken = []
    for form, pat in (("full", FULL), ("short", SHORT), ("loud", LOUD), ("turned", TURNED)):
        for m in pat.finditer(text, overlapped=form in ("full", "turned")):
            given, last = m.group(1), m.group(2)
            if form == "turned":
                if given.lower() in SALUTATIONS or any(a < m.end() and m.start() < b for a, b in taken):
                    continue
                if regex.match(rf"{GAP}(?:{INITIAL}|{CAP})", text[m.end() : m.end() + 20]) and BEFORE.search(text[max(0, m.start() - 40) : m.start()]) is None:
                    continue
                given, last = last, given
            strong = BEFORE.search(text[max(0, m.start() - 40) : m.start()]) is not None or AFTER.match(text[m.end() : m.end() + 60]) is not None
            if form != "turned" and strong:
                taken.append(m.span())
            yield m.start(), m.end(), given.split("-")[0].lower(), last.split("-")[0].lower(), strong


def _veiled(text: str) -> Iterator[tuple[int, int]]:
    for m in VEILED.finditer(text):
        line = max(text.rfind("\n", 0, m.start()) + 1, m.start() - 200)
        name = VEILED_NAME.search(text, line, m.start())
        if name:
            yield name.start(), m.end()


def _apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _clash(a: int, b: int, others: list[tuple[int, int]]) -> bool:
    """Whether a span meets one of ``others``, which are in order and apart."""
    i = bisect.bisect_left(others, (b,))
    return i > 0 and others[i - 1][1] > a


def mentions(text: str) -> list[tuple[int, int, str, str, str, bool]]:
    """(start, end, type, first word, last word, strong); the words only for possible names."""
    out, low = [], text.lower()
    mails = _apart([m.span() for m in EMAIL.finditer(text)] + list(_veiled(text)))
    out += [(a, b, "email", "", "", True) for a, b in mails]
    ids = [m.span() for m in BARE_ID.finditer(text) if not NO_ID_BEFORE.search(text[max(0, m.start() - 30) : m.start()]) and not NO_ID_AFTER.match(text[m.end() : m.end() + 60])] + [m.span(1) for m in _from_words(NAMED_ID, "id", ID_STARTS, text, low)]
    streets = [m.span() for m in ADDRESS.finditer(text)]

    ids, streets = _apart(ids), _apart(streets)
    phones = []
    for m in PHONE.finditer(text):
        n = sum(c.isdigit() for c in regex.sub(EXT + "$", "", m.group()))
        if 8 <= n <= 15 and not _clash(*m.span(), ids):
            phones.append(m.span())
    sure = _apart(phones)
    for m in _from_words(CALLED, "call", CALL_STARTS, text, low):
        a, b = m.span(1)
        n = sum(c.isdigit() for c in m.group(1))
        if 6 <= n <= 15 and not _clash(a, b, ids) and not _clash(a, b, sure) and not regex.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}|\d{1,2}[:.]\d{2}|\d{4}-\d{2}-\d{2}.*|\d+\.\d+\.\d+", m.group(1)):
            phones.append((a, b))
    out += [(a, b, "id_number", "", "", True) for a, b in ids]
    out += [(a, b, "phone", "", "", True) for a, b in phones]
    out += [(a, b, "address", "", "", True) for a, b in streets]
    for a, b, g, s, strong in _name_rows(text):
        if not _clash(a, b, mails) and not _clash(a, b, streets):
            out.append((a, b, "person_name", g, s, strong))
    return out


ROWS = "line_no bigint, pii_type string, start bigint, stop bigint, value string, given string, last string, strong boolean"


def candidate_mentions(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, pii_type, start, stop, value, given, last, strong); names are candidates still."""
    kind = dict(documents.dtypes)[key]
    ship(documents.sparkSession)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["k"], b["t"]):
                starts = [0, *[i + 1 for i, c in enumerate(t) if c == "\n"]]
                rows += [(k, _line(starts, a), what, a, z, t[a:z], g, s, strong) for a, z, what, g, s, strong in mentions(t)]
            yield pd.DataFrame(rows, columns=["k", "line_no", "pii_type", "start", "stop", "value", "given", "last", "strong"])

    return documents.where(F.col(text) != "").select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(scan, f"k {kind}, {ROWS}").withColumnRenamed("k", key)


#: What follows a part of an address written out, which is no word written small.
DOTTED = r" ?[\[({]? ?(?:dot|punto|point|punkt|at|arroba|arobase|ät)[\])} ]"


def _word_counts(documents: DataFrame, words: DataFrame, text: str) -> DataFrame:
    """(word, small): in how many texts each of ``words`` is written small, as a word of its own."""
    small = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_@.+/-]|[ \])](?:dot|punto|point|punkt)[\]) ])(\p{Ll}[\p{Ll}\p{M}'’]+)(?![\p{L}\p{N}_@/+-]|\.\p{L}|" + DOTTED + r")"), F.lit(1)))
    return documents.where(F.col(text) != "").select(F.explode(small).alias("word")).join(words, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("small"))


def find_personal_data(documents: DataFrame, key: str = "doc_id", text: str = "text", least_seen: int = 3, small_share: float = 0.02, known_share: float = 0.25) -> DataFrame:
    """(key, line_no, pii_type, start, stop, value): every mention, ``line_no`` where it starts.

    Null and empty texts hold none.  A candidate is a person's name if its last
    word is hardly ever written small in the corpus (in one text, or in under
    ``small_share`` times as many as the places where it is a candidate's word) and it stands where names stand, or
    its first word is an initial or does so in at least ``least_seen``
    candidates and a ``known_share`` of them.
    """
    found = materialize(candidate_mentions(documents, key, text), "mentions")
    names = found.where(F.col("pii_type") == "person_name")
    pairs = names.groupBy("given", "last").agg(F.count(F.lit(1)).alias("n"), F.count_if("strong").alias("n_strong"))
    pairs = materialize(pairs, "pairs")
    sides = pairs.select(F.explode(F.array(F.struct(F.col("given").alias("word"), F.lit(True).alias("first")), F.struct(F.col("last").alias("word"), F.lit(False).alias("first")))).alias("s"), "n", "n_strong")
    seen = sides.groupBy(F.col("s.word").alias("word")).agg(F.sum("n").alias("seen"), F.sum(F.when(F.col("s.first"), F.col("n_strong"))).alias("first_strong"), F.sum(F.when(F.col("s.first"), F.col("n"))).alias("first_seen"))
    seen = materialize(seen, "seen")
    stats = materialize(seen.join(_word_counts(documents, seen.select("word"), text), "word", "left").select("word", F.coalesce("first_strong", F.lit(0)).alias("first_strong"), F.coalesce("first_seen", F.lit(0)).alias("first_seen"), (F.coalesce("small", F.lit(0)) > F.col("seen") * small_share + 1).alias("common")), "stats")
    g = stats.select(F.col("word").alias("given"), F.col("first_strong").alias("g_strong"), F.col("first_seen").alias("g_seen"), F.col("common").alias("g_common"))
    s = stats.select(F.col("word").alias("last"), F.col("common").alias("l_common"))
    judged = pairs.join(g, "given", "left").join(s, "last", "left")
    initial = F.col("given").rlike(r"^\p{L}\.$")
    known = (F.col("g_strong") >= least_seen) & (F.col("g_strong") >= known_share * F.col("g_seen"))
    plain = ~F.coalesce("g_common", F.lit(False)) | known
    sure = judged.select("given", "last", (~F.coalesce("l_common", F.lit(False)) & (initial | plain)).alias("_ok"), (initial | known).alias("_known"))
    kept = names.join(sure.where("_ok"), ["given", "last"]).where(F.col("strong") | F.col("_known"))
    cols = [key, "line_no", "pii_type", "start", "stop", "value"]
    return found.where(F.col("pii_type") != "person_name").select(*cols).unionByName(kept.select(*cols))


def mention_lines(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no, pii_type), each once."""
    return found.select(key, "line_no", "pii_type").distinct()


#: First names whose ending would mislead, by the gender they suggest.
GIVEN_GENDER = {
    **dict.fromkeys("luca nicola andrea joshua george mike luke jose josé lukas elia noah ezra jona sasha nikita ilja ilya kuba dave steve pete joe kyle lance bruce claude antoine philippe pierre etienne guillaume alexandre jesse uwe malte ole arne bjarne hauke helge sönke kwame никита илья".split(), "m"),
    **dict.fromkeys("carmen ingrid astrid ines inés judith ruth edith miriam marion sharon susan karen helen ellen megan erin lauren robyn carol isabel raquel pilar dolores mercedes rosario consuelo agnes doris iris lois gladys frances beth elizabeth margaret sarah hannah deborah rachel anouk maud birgit margit gudrun heidrun любовь".split(), "f"),
}
#: Parts of made-up names, by script: onsets, vowels, codas, endings of first names by gender, of surnames.
SYLLABLES = {
    "latin": ("b d f g h k l m n p r s t v w z br dr gr kl pl st tr".split(), "a e i o u".split(), "l m n r s t nd rk st rn".split(), {"f": "a ia ina ela".split(), "m": "us an or ek".split(), "n": "y i el is".split()}, [""]),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х бр гр др кр ст тр".split(), "а е и о у".split(), "л м н р с т".split(), {"f": "а ина ия ева".split(), "m": "ан ор ей ик".split(), "n": "и ай эль".split()}, ["ов", "ин", "ский"]),
    "greek": ("β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ".split(), "α ε η ι ο".split(), "λ μ ν ρ σ τ".split(), {"f": "α η ια".split(), "m": "ος ης ας".split(), "n": "ι ω".split()}, ["ίδης", "άκης", "ος"]),
}
LETTERS = {"latin": "abcdefghijklmnoprstuvwz", "cyrillic": "абвгдежзиклмнопрстуф", "greek": "αβγδεζηθικλμνοπρστφ"}
PARTICLES = set("van der den de von zu la los del della da di dos le ten ter af bin ibn al el o".split())
#: From this draw on surrogates get longer with each draw, so that free ones never run out.
GROWS = 4


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest()[:16], "big")


def _pick(n: int, options: list[str]) -> tuple[str, int]:
    return options[n % len(options)], n // len(options)


def gender(given: str) -> str:
    """What a first name suggests: known ones by table, others by their ending, else neutral."""
    w = given.lower().split("-")[0]
    if w in GIVEN_GENDER:
        return GIVEN_GENDER[w]
    if len(w) < 3:
        return "n"
    return "f" if w[-1] in "aаяαη" else "m" if w[-1] in "oskrndtjоркнсς" else "n"


def script(word: str) -> str:
    c = word[:1].lower()
    return "cyrillic" if "а" <= c <= "я" or c in "ёіїє" else "greek" if "α" <= c <= "ω" or "ά" <= c <= "ώ" else "latin"


def _like(word: str, pattern: str) -> str:
    return word.upper() if pattern.isupper() and len(pattern) > 1 else word.capitalize() if pattern[:1].isupper() else word.lower()


def name_part(key: bytes, kind: str, token: str, salt: int) -> str:
    """A made-up first name of the same gender, or surname, in the script of ``token``; small letters."""
    onsets, vowels, codas, first, last = SYLLABLES[script(token)]
    n, out = _number(key, kind, token, salt), ""
    for _ in range((1 if kind == "given" else 2) + n % 2 + max(0, salt - GROWS)):
        a, n = _pick(n, onsets)
        b, n = _pick(n, vowels)
        out += a + b
    coda, n = _pick(n, codas)
    return out + coda + _pick(n, first[gender(token)] if kind == "given" else last)[0]


def _same_shape(key: bytes, what: str, value: str, salt: int, keep: int = 0) -> str:
    """Digits to digits, capitals to capitals, small letters to small ones; the first ``keep`` characters stay."""
    entity = regex.sub(r"[\s./()-]", "", value)
    n, out = _number(key, what, entity, salt), []
    for i, c in enumerate(value):
        if i < keep or not (c.isascii() and c.isalnum()):
            out.append(c)
            continue
        if n < 1 << 20:
            n = _number(key, what, entity, salt, sum(x.isalnum() for x in value[:i]))
        size = 10 if c.isdigit() else 26
        out.append(chr(ord("0" if c.isdigit() else "A" if c.isupper() else "a") + n % size))
        n //= size
    return "".join(out) + "".join(str(_number(key, what, entity, salt, "more", j) % 10) for j in range(max(0, salt - GROWS)))


def surrogate(key: bytes, what: str, value: str, salt: int = 0) -> str:
    """A replacement of the same type and format; equal for equal entities, however they are spelled."""
    if what == "email":
        local, _, domain = value.lower().partition("@")
        return f"{name_part(key, 'surname', local, salt)}.{name_part(key, 'surname', local + '1', salt)}@{name_part(key, 'surname', domain, 0)}.example"
    if what == "phone":
        return _same_shape(key, what, value, salt, 3 if value.startswith("+") else 2 if value.startswith("00") else 1 if value[:1] in "0(" else 0)
    if what == "id_number":
        return _same_shape(key, what, value, salt)
    words = regex.split(r"(\s+)", value)
    swap = [w for w in words if w[:1].isupper() and not regex.fullmatch(STREET_EN + r"|Rue|Avenue|Calle|Avenida|Plaza|Paseo|Place|Boulevard|Am|An|Im|In|Apt", w)]
    out = []
    for w in words:
        tail = regex.search(r"(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|damm|ufer)$", w)
        if w and w[0].isdigit():
            out.append(_same_shape(key, "house", w, salt))
        elif w in swap:
            out.append(_like(name_part(key, "surname", w.lower(), salt), w) + (tail.group() if tail else ""))
        else:
            out.append(w)
    return "".join(out)


def normal_form(what: str, value: str) -> str:
    """One form per entity: spelling, case and separators aside."""
    return regex.sub(r"[\s./()\-]+", " " if what == "address" else "", value).strip().casefold()


def name_parts(value: str) -> list[tuple[str, str, str]]:
    """(kind, token, text) of a name's pieces: given, initial, surname, or the text between, which stays.

    The surname is the last word, or the one before a comma; words joined by a
    hyphen are pieces of their own, particles stay.
    """
    pieces = [x for x in regex.split(r"(\p{Lu}\.|[\p{L}\p{M}’']+)", value) if x]
    words = [i for i, x in enumerate(pieces) if regex.match(r"\p{L}", x) and not regex.fullmatch(INITIAL, x) and (x.lower() not in PARTICLES or x[:1].isupper() and len(x) > 2)]
    comma = next((i for i, x in enumerate(pieces) if "," in x), None)
    if not words:
        return [("", "", x) for x in pieces]
    anchor = max((i for i in words if comma is None or i < comma), default=words[-1])
    last = {anchor}
    while anchor >= 2 and pieces[anchor - 1] == "-" and anchor - 2 in words:
        anchor -= 2
        last.add(anchor)
    out = []
    for i, x in enumerate(pieces):
        if regex.fullmatch(INITIAL, x):
            out.append(("initial", x[0].lower(), x))
        elif i in last:
            out.append(("surname", x.casefold(), x))
        elif i in words:
            out.append(("given", x.casefold(), x))
        else:
            out.append(("", "", x))
    return out


def _distinct_draws(tokens: DataFrame, taken: DataFrame, draw: Callable[..., Column]) -> DataFrame:
    """(kind, token, drawn): every token its own draw, none equal to another's or to one of ``taken`` (kind, drawn).

    Of tokens that collide the smallest keeps its draw, the others draw again;
    draws get longer from the fifth on, so the loop ends.
    """
    kept: list[DataFrame] = []
    left, salt = tokens.withColumn("salt", F.lit(0)), 0
    used = taken
    while True:
        cur = materialize(left.select("kind", "token", draw("kind", "token", F.lit(salt)).alias("drawn")), "drawn")
        free = cur.join(used, ["kind", "drawn"], "left_anti")
        first = free.groupBy("kind", "drawn").agg(F.min("token").alias("token"))
        won = materialize(first.select("kind", "token", "drawn"), "won")
        kept.append(won)
        used = used.unionByName(won.select("kind", "drawn"))
        left = materialize(cur.join(won, ["kind", "token"], "left_anti").select("kind", "token"), "left")
        release(cur)
        salt += 1
        if left.isEmpty():
            return union_all(kept)


def assign_surrogates(found: DataFrame, secret: str) -> DataFrame:
    """(pii_type, value, replacement): distinct entities of one type never share a replacement, nor get one that occurs.

    A person has one record: every first name and every surname has one
    replacement wherever it stands, of its script and, for first names, gender;
    an initial beside a surname takes that of the replacement of the first name
    that goes with both somewhere in the corpus (of several the smallest), so
    full and short forms stay one person; other initials get a letter of their
    own beside each surname.  Other entities are one whatever their
    case and separators.  Letters of scripts without case form no names here.
    """
    key = secret.encode()
    ship(found.sparkSession)

    @F.pandas_udf(StringType())
    def draw(what: pd.Series, value: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, w, v, int(s)) for w, v, s in zip(what, value, salt)])

    @F.pandas_udf(StringType())
    def draw_form(what: pd.Series, value: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([normal_form(w, surrogate(key, w, v, int(s))) for w, v, s in zip(what, value, salt)])

    @F.pandas_udf(StringType())
    def draw_part(kind: pd.Series, token: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([name_part(key, k, t, int(s)) for k, t, s in zip(kind, token, salt)])

    @F.pandas_udf(StringType())
    def draw_letter(surname: pd.Series, token: pd.Series, salt: pd.Series) -> pd.Series:
        out = []
        for n, t, k in zip(surname, token, salt):
            letters = LETTERS[script(t)]
            at = (_number(key, "initial", n, t) + int(k)) % len(letters)
            out.append(letters[at] * (1 + int(k) // len(letters)))
        return pd.Series(out)

    @F.pandas_udf(StringType())
    def norm(what: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([normal_form(w, v) for w, v in zip(what, value)])

    @F.pandas_udf("array<struct<kind: string, token: string, text: string>>")
    def split(value: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "token": t, "text": x} for k, t, x in name_parts(v)] for v in value])

    values = materialize(found.select("pii_type", "value").distinct(), "values")
    # all but names: an entity's smallest spelling stands for it in the search for a free draw, each spelling is then drawn in its own format
    plain = materialize(values.where(F.col("pii_type") != "person_name").select(F.col("pii_type").alias("kind"), "value", norm("pii_type", "value").alias("entity")), "entities")
    heads = plain.groupBy("kind", "entity").agg(F.min("value").alias("token"))
    taken = plain.select("kind", F.col("entity").alias("drawn")).distinct()
    salted = _free_salts(heads, taken, draw_form)
    other = plain.join(salted, ["kind", "entity"]).select(F.col("kind").alias("pii_type"), "value", draw("kind", "value", "salt").alias("replacement"))
    # names: by their parts
    named = values.where(F.col("pii_type") == "person_name").select("value", F.posexplode(split("value")).alias("at", "p")).select("value", "at", "p.kind", "p.token", "p.text")
    named = materialize(named, "parts")
    parts = named.where(F.col("kind").isin("given", "surname")).select("kind", "token").distinct()
    both = parts.select("token").distinct()
    taken = both.select(F.explode(F.array(F.lit("given"), F.lit("surname"))).alias("kind"), F.col("token").alias("drawn"))
    drawn = materialize(_distinct_draws(parts, taken, draw_part), "names")
    surname = named.where("kind = 'surname'").groupBy("value").agg(F.min_by("token", "at").alias("surname"))
    full = named.where("kind = 'given'").join(surname, "value").groupBy("surname", F.substring("token", 1, 1).alias("letter")).agg(F.min("token").alias("token"))
    meant = full.join(drawn.where("kind = 'given'"), "token").select("surname", F.col("letter").alias("token"), F.substring("drawn", 1, 1).alias("meant"))
    alone = named.where("kind = 'initial'").join(surname, "value").select(F.col("surname").alias("kind"), "token").distinct()
    known = meant.select(F.col("surname").alias("kind"), "token", F.col("meant").alias("drawn"))
    lone = _distinct_draws(alone.join(known, ["kind", "token"], "left_anti"), known.select("kind", "drawn"), draw_letter)
    letters = known.unionByName(lone).select(F.col("kind").alias("surname"), "token", F.col("drawn").alias("meant"))
    told = named.join(surname, "value", "left").join(drawn, ["kind", "token"], "left").join(letters, ["surname", "token"], "left")

    @F.pandas_udf(StringType())
    def render(text: pd.Series, kind: pd.Series, drawn: pd.Series, meant: pd.Series) -> pd.Series:
        out = []
        for x, k, d, m in zip(text, kind, drawn, meant):
            if k == "initial":
                out.append((m if isinstance(m, str) else x[0]).upper() + ".")
            else:
                out.append(_like(d, x) if isinstance(d, str) else x)
        return pd.Series(out)

    done = told.select("value", "at", render("text", "kind", "drawn", "meant").alias("r"))
    names = done.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("at", "r"))).alias("l"))  # the parts of one name
    return other.unionByName(names.select(F.lit("person_name").alias("pii_type"), "value", F.array_join(F.transform("l", lambda x: x["r"]), "").alias("replacement")))


def _free_salts(heads: DataFrame, taken: DataFrame, draw_form: Callable[..., Column]) -> DataFrame:
    """(kind, entity, salt): the first draw of each entity whose form no other entity has or is drawn."""
    done: list[DataFrame] = []
    left, salt, used = heads, 0, taken
    while True:
        cur = materialize(left.select("kind", "entity", "token", draw_form("kind", "token", F.lit(salt)).alias("drawn")), "drawn")
        won = materialize(cur.join(used, ["kind", "drawn"], "left_anti").groupBy("kind", "drawn").agg(F.min("entity").alias("entity")).withColumn("salt", F.lit(salt)), "won")
        done.append(won.select("kind", "entity", "salt"))
        used = used.unionByName(won.select("kind", "drawn"))
        left = materialize(cur.join(won, ["kind", "entity"], "left_anti").select("kind", "entity", "token"), "left")
        release(cur)
        salt += 1
        if left.isEmpty():
            return union_all(done)


def replace_personal_data(documents: DataFrame, found: DataFrame, secret: str | None = None, key: str = "doc_id", text: str = "text", to: str = "redacted_text") -> DataFrame:
    """(key, to): texts with typed placeholders such as ``[EMAIL]``, or with surrogates keyed by ``secret``.

    ``key`` tells texts apart; rows that repeat it must repeat the text.  A null key is a key.
    """
    if secret is None:
        spans = found.select(key, "start", "stop", F.concat(F.lit("["), F.upper("pii_type"), F.lit("]")).alias("replacement"))
    else:
        spans = found.join(assign_surrogates(found, secret), ["pii_type", "value"]).select(key, "start", "stop", "replacement")
    per = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "replacement"))).alias("_s"))  # as many as one text has

    @F.pandas_udf(StringType())
    def splice(texts: pd.Series, marks: pd.Series) -> pd.Series:
        res = []
        for t, ms in zip(texts, marks):
            if t is None or ms is None or not len(ms):
                res.append(t)
                continue
            out, last = [], 0
            for m in sorted(ms, key=lambda m: (m["start"], -m["stop"])):
                if m["start"] >= last:
                    out += [t[last : m["start"]], m["replacement"]]
                    last = m["stop"]
            res.append("".join([*out, t[last:]]))
        return pd.Series(res)

    spans = per.select(F.col(key).alias("_k"), "_s")
    return documents.select(F.col(key), F.col(text).alias("_t")).join(spans, F.col(key).eqNullSafe(F.col("_k")), "left").select(key, splice("_t", "_s").alias(to))
