"""Problem 2: prompt and answer pairs that are of no use, with the kind of their defect.

Truncated answers come from ``truncation`` (neighbours in sorted order, line ends, structure); the rules here find
answers that are empty shells, refusals, copies of the prompt, or in another language than the prompt's prose.
"""

from __future__ import annotations

import functools
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import truncation

#: Share of an answer's letters that must lie in runs copied from the prompt.
COPIED_SHARE, PATCH_COPIED_SHARE = 0.85, 0.97
RUN = 20
#: Blocks for a bound on the copied share: of the places in a run, one is a multiple of STEP with a whole block behind it.
STEP = 10
BLOCK = RUN - STEP + 1

#: Words that say nothing by themselves in an answer without any other.
_SHELL = frozenset("null none nil n a na undefined empty todo tbd no json patches rationale change changes file files answer response result output br p div code pre".split())
_ANY_WORD = re.compile(r"[^\W_]+")
#: What a refusal has somewhere, for a quick look before the long list is tried.
_HINT = re.compile(r"\b(?:i|we|me|my|our|mir|ich|je|moi|lo|no|muss|request|prompt|task|helping|assisting|answering|content|matter)\b|refus|declin|denied|reject|against|beyond|outside|désol|lehne|[^\x00-\x7f]", re.I)
_CODE_KEYS = frozenset("search replace patched path content original code diff patch from to source target import_statement target_edge new_content src dst file lines append prepend strategy id line operation".split())
#: A number that an answer puts before a line.
_NUMBERED = re.compile(r"[ \t>]*\d+(?:[ \t]*[:|.)\]]|[ \t]|$)")
_NOT_ALNUM = re.compile(r"[\W_]+")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_WORD = re.compile(r"[^\W\d_]+")
_FENCED = re.compile(r"```.*?(?:```|\Z)", re.S)
_SEARCH = re.compile(r"<<<<<<< SEARCH.*?(?:>>>>>>> REPLACE|\Z)", re.S)
_FILE_LINE = re.compile(r"^(?:--- FILE:.*|cycle_\w+:.*)$", re.M)
_IDENT = re.compile(r"`[^`\n]*`|\b[\w./\\-]+\.(?:tsx?|m?jsx?|py|cs|java|json|conf)\b|\b\w*[a-z]\w*[A-Z]\w*(?:\.\w+(?:\([^()]*\))?)*|\b\w+\([^()]*\)|\b\w+_\w+\b")
_QUOTED = re.compile(r"\"[^\"\n]{0,300}\"|“[^”\n]{0,300}”|«[^»\n]{0,300}»|„[^“\n]{0,300}“|「[^」\n]{0,300}」")
_CODE_LINE = re.compile(r"^(?:\s*(?:import |from |export |const |let |var |class |def |public |private |using |namespace |package |return|if |for |while |//|/\*|\*|#|@|[{}()\[\]]|\w+\(|this\.|self\.|try|except|catch|throw|raise|with |else|elif|case |switch|default|break|_\w+).*|.*[;{}(,]\s*|\s{2,}.*)$", re.M)

# fixed values: frequent small words of the languages told apart by words
SMALL = {
    "en": "the of and to in is that it for was on are as with be by this not but from they at which or an have has were their its than then into only after before each what why when if no so does do we i you one two most still however",
    "de": "der die das und ist nicht ein eine den dem des mit auf für von zu im wird nur noch sich auch nach bei aus wir wurde werden siehe bitte kann ich sie es oder als wie warum beim zum über vor nun dadurch danach bleibt",
    "fr": "le la les des et est une un du en pour que qui dans pas ne sur au avec ce cette plus il elle sont par se donc après ainsi vous nous pourquoi fichier voir mme sans aux deux ces",
    "es": "el la los las de y que en un una es por con no se del al lo para como más así tras su sus esta este ya solo quedan véase qué archivo línea entre cuando desaparece muy puedo",
    "pt": "o os as um uma não para com que em por do da dos das ao mais são foi também já esta este como",
    "it": "il lo gli di che è un una non per con del della dei sono al alla più come questo questa anche nel",
    "nl": "de het een en van is niet op te dat met voor zijn er aan ook maar om dit bij wordt",
    "pl": "nie to jest się na że do jak ale po co tak za od przez już tylko lub dla",
}
_SMALL = {lang: frozenset(words.split()) for lang, words in SMALL.items()}

# fixed values: ways to decline a task
REFUSAL = re.compile(
    r"""
    \b(?:i|we)\s*(?:'m|’m|\sam|\sare|'re)\s+(?:sorry,?\s+but\s+i|afraid\s+(?:that\s+)?(?:i\s+(?:can|must|won|am)|(?:helping|this|that)\b.{0,40}\bnot\b)|not\s+(?:able|allowed|permitted|authori[sz]ed|in\s+a\s+position|going\s+to|comfortable)|unable|prohibited|forbidden|barred)
  | \bas\s+an\s+(?:ai|assistant|language\s+model)\b.{0,60}\b(?:not|cannot|can't|unable)\b
  | \b(?:i|we)\s+(?:cannot|can\s?not|can['’]t|could\s+not|won['’]t|will\s+not|shall\s+not|must\s+not|do\s+not|don['’]t|am\s+unable\s+to|would\s+rather\s+not|prefer\s+not\s+to|may\s+not)\s+(?:\w+ly\s+)?(?:be\s+able\s+to\s+)?(?:assist|help|provide|comply|answer|fulfil|fulfill|produce|support|process|give|offer|create|write|generate|share|complete|carry|continue|proceed|discuss|respond|touch|change|edit|modify|work\s+on|do\s+(?:that|this|so)|take\s+(?:this|that)\s+on|feel\s+comfortable|participate|engage|inspect|accept|handle|make)\b(?!.{0,20}\bso\s+its\s+import)
  | \b(?:i|we)\s+(?:(?:must|have\s+to|need\s+to|will|shall|am\s+going\s+to)\s+)?(?:\w+ly\s+)?(?:decline|refuse|turn\s+(?:this|that|it)?\s*down|pass\s+on\s+this|abstain)\b
  | \bsomething\s+(?:that\s+)?(?:i|we)\s+(?:have\s+to\s+(?:turn\s+down|decline|refuse)|do\s+not\s+do|don['’]t\s+do|cannot\s+do|can['’]t\s+do|won['’]t\s+do|am\s+not|must)\b | \bnot\s+something\s+(?:that\s+)?(?:i|we)\s+(?:can|am|do|will|may|could)\b
  | \boutside\s+(?:of\s+)?(?:what\s+i\b|my\s+(?:remit|scope|role|mandate|permissions)|the\s+(?:scope|bounds)\s+of\s+what) | \bbeyond\s+what\s+i\s+(?:can|may|am)\b
  | \bagainst\s+(?:the\s+|my\s+|our\s+)?(?:usage\s+|content\s+|safety\s+|company\s+)?(?:rules|polic(?:y|ies)|guidelines|instructions|principles|guidance)\b | \b(?:go|goes|going)\s+against\s+(?:my|our|the)\b
  | \b(?:my|our)\s+(?:instructions|guidelines|rules|polic(?:y|ies))\s+(?:rule\s+out|forbid|prohibit|prevent|do\s+not\s+allow|don['’]t\s+allow)
  | \bcontent\s+policy\b | \bmatter\s+of\s+policy\b | \b(?:request|prompt|task)\s+(?:was\s+|is\s+|has\s+been\s+)?(?:declined|refused|denied|rejected)\b
  | \bno\s+(?:answer|help|patch|response)\s+can\s+be\s+(?:given|provided|offered)\b | \b(?:helping|assisting|answering)\b.{0,20}\bis\s+not\s+possible\s+for\s+me\b
  | \bwould\s+(?:not\s+be\s+(?:appropriate|right|responsible|proper)|be\s+(?:irresponsible|inappropriate|improper|wrong))\s+(?:of|for)\s+me\b
  | \bwe\s+do\s+not\s+answer\b | \bnot\s+(?:permitted|allowed)\s+to\s+(?:help|assist|answer|provide|change|edit|touch|modify)\b
  | \b(?:kann|darf|möchte|werde|könnte)\s+ich\b.{0,40}\b(?:nicht|keine?n?)\b | \bich\s+(?:kann|darf|möchte|werde)\b.{0,60}\b(?:nicht|keine?n?)\b | \b(?:muss|möchte)\s+(?:ich\s+)?(?:\w+\s+){0,4}(?:ablehnen|verweigern)\b | \blehne\s+ich\b | \btut\s+mir\s+leid\b
  | \bje\s+(?:ne\s+(?:peux|suis|puis|saurais)\b|(?:suis\s+)?désolée?\b|regrette\b|dois\s+(?:\w+\s+){0,2}(?:refuser|décliner)|refuse\b|décline\b) | \bdésolée?,?\s+mais\b | \bimpossible\s+pour\s+moi\b
  | \blo\s+siento\b | \bno\s+(?:puedo|podré|podemos|debo|me\s+es\s+posible|estoy\s+autorizad[oa]|me\s+está\s+permitido)\b | \b(?:debo|tengo\s+que)\s+(?:\w+\s+){0,2}(?:rechazar|negarme|declinar)
  | (?:не\s+(?:могу|можем|вправе|буду|имею\s+права)|вынужден\w*|отказ(?:аться|ываюсь|ываемся)|к\s+сожалению,?\s+(?:я\s+)?не|извините|прошу\s+прощения)
  | (?:抱歉|对不起|很遗憾|不好意思).{0,20}(?:不能|无法|不便|不可以|拒绝) | 我(?:不能|无法|不便|不会|必须拒绝|只能拒绝) | (?:拒绝|无法)(?:回答|提供|协助|处理|完成)
  | 申し訳.{0,40}(?:ません|できない|お断り|ありません) | (?:お手伝い|お答え|対応|回答|ご協力|お応え)(?:は|する(?:こと)?は|すること)?(?:でき(?:ません|ない|かね)|いたしかね|しかね) | お断り | 応じ(?:られ|かね)
  | (?:δεν\s+μπορώ|λυπάμαι|αρνούμαι|δεν\s+επιτρέπεται\s+να) | (?:لا\s+أستطيع|لا\s+يمكنني|عذرا|آسف|أعتذر|أرفض) | (?:क्षमा|खेद|मैं.{0,30}(?:नहीं\s+कर\s+सकता|असमर्थ)) | (?:ขออภัย|ไม่สามารถ(?:ช่วย|ตอบ|ดำเนินการ))
    """,
    re.I | re.X | re.S,
)
_STATUS = re.compile(r"\"(?:status|error|result|state|outcome|decision)\"\s*:\s*\"(?:refus|declin|denied|reject|i\s+(?:am|cannot|can't|won't)\b)", re.I)
_SENTENCE = re.compile(r"(?<=[.!?。！？;])\s+|\n")
#: Remarks about the code, and ways to open an answer, that hold such words without declining.
_REMARK = re.compile(r"(?:i|we)\s+(?:can['’]t|cannot)\s+(?:find|see|load)\b[^.]*\.|sorry\s+for\s+the\s+[^.]*\.|unfortunately\s+\S+\s+also\s+needs[^.]*\.", re.I)


@functools.lru_cache(maxsize=2)
def _json(text: str):
    """The JSON payload of an answer, or None."""
    end = truncation.json_end(text)
    if not end or end[0] != "closed":
        return None
    m = truncation._JSON_START.search(text)
    try:
        return json.loads(text[m.start(1) : end[1]], strict=False)
    except (ValueError, RecursionError):
        return None


def _leaves(x, key: str = "") -> list[tuple[str, str]]:
    out, todo = [], [(key, x)]
    while todo:
        k, v = todo.pop()
        if isinstance(v, dict):
            todo += [(str(a).lower(), b) for a, b in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(k, b) for b in reversed(v)]
        elif isinstance(v, str):
            out.append((k, v))
        elif v is not None and not isinstance(v, bool):
            out.append((k, str(v)))
    return out


def is_empty(text: str) -> bool:
    """Nothing, or a shell without any statement."""
    data = _json(text)
    if data is not None:
        end = truncation.json_end(text)[1]
        m = truncation._JSON_START.search(text)
        around = text[: m.start(1)] + text[end:]
        return not any(not is_blank(v) for _, v in _leaves(data)) and is_blank(around)
    return is_blank(text)


def is_blank(text: str) -> bool:
    return all(m.group().lower() in _SHELL for m in _ANY_WORD.finditer(text))


def has_patch(text: str, data) -> bool:
    """Whether the answer carries a change to code."""
    if "<<<<<<< SEARCH" in text:
        return True
    if data is not None:
        return any(k in ("search", "replace", "patched", "content", "diff", "new_content", "import_statement") and v.strip() for k, v in _leaves(data))
    return any(len(f) > 12 for f in _FENCED.findall(text))


def is_refusal(text: str, data) -> bool:
    if has_patch(text, data):
        return False
    if data is not None and _STATUS.search(text):
        return True
    said = text if data is None else "\n".join(v for _, v in _leaves(data))
    return any(REFUSAL.search(_QUOTED.sub(" ", _REMARK.sub(" ", part))) for part in _SENTENCE.split(said) if _HINT.search(part))


def squash(text: str) -> str:
    """The letters and digits of ``text``, without case, layout and punctuation."""
    return _NOT_ALNUM.sub("", text).lower()


def is_copied(prompt: str, text: str, data) -> bool:
    """Nothing but (a large part of) the prompt: almost all of the answer's letters lie in runs that the prompt has too."""
    last = text.rstrip().rsplit("\n", 1)[-1].strip()
    if data is not None or last.startswith("<<<") and last not in prompt:
        return False
    share = PATCH_COPIED_SHARE if "<<<<<<< SEARCH" in text else COPIED_SHARE  # a patch quotes what it replaces
    p = squash(prompt)
    if _in_runs(squash(text), p, share):
        return True
    lines = [x for x in text.splitlines() if x.strip()]
    return len(lines) > 1 and all(map(_NUMBERED.match, lines)) and _in_runs(squash("\n".join(_NUMBERED.sub("", x) for x in lines)), p, share)


def _in_runs(a: str, p: str, share: float) -> bool:
    """Whether ``share`` of ``a`` lies in runs of :data:`RUN` letters that ``p`` has too."""
    if len(a) <= RUN or not p:
        return len(a) >= 12 and a in p
    if a in p:
        return True
    # each run of p holds a whole block of BLOCK letters that begins at a multiple of STEP, so a common run lies around a block that a has too
    blocks = {p[i : i + BLOCK] for i in range(0, len(p) - BLOCK + 1, STEP)}
    most = last = 0
    for i in range(len(a) - BLOCK + 1):
        if a[i : i + BLOCK] in blocks:
            end = min(i + RUN, len(a))
            most += end - max(last, i - STEP + 1)
            last = end
    if most < share * len(a):
        return False
    runs = {p[i : i + RUN] for i in range(len(p) - RUN + 1)}
    held = last = 0
    for i in range(len(a) - RUN + 1):
        if a[i : i + RUN] in runs:
            held += i + RUN - max(last, i)
            last = i + RUN
    return held >= share * len(a)


def without_names(text: str) -> str:
    """``text`` without identifiers, which would count as Latin letters; a text in ASCII is judged by its small words only."""
    return text if text.isascii() else _IDENT.sub(" ", text)


def prose(text: str, data=None) -> str:
    """What is neither code, identifiers nor structure."""
    if data is not None:
        m, end = truncation._JSON_START.search(text), truncation.json_end(text)[1]
        text = " ".join(v for k, v in _leaves(data) if k not in _CODE_KEYS) + "\n" + text[: m.start(1)] + "\n" + text[end:]
    if "```" in text:
        text = _FENCED.sub(" ", text)
    if "<<<" in text:
        text = _SEARCH.sub(" ", text)
    if "--- FILE:" in text or "cycle_" in text:
        text = _FILE_LINE.sub(" ", text)
    return without_names(text)


def prompt_prose(prompt: str) -> str:
    """The instruction of a prompt: what stands around the quoted file."""
    start, end = prompt.find("--- FILE:"), prompt.rfind("--- FILE:")
    if start < 0:
        return without_names(_FILE_LINE.sub(" ", _FENCED.sub(" ", prompt)))
    tail = prompt[end:].rsplit("\n\n", 1)
    after = tail[-1] if len(tail) > 1 and not _CODE_LINE.match(tail[-1].split("\n")[0]) else ""
    return without_names(_FILE_LINE.sub(" ", _FENCED.sub(" ", prompt[:start])) + " " + after)


_SCRIPTS = {"zh": "[㐀-鿿]", "ja": "[぀-ヿ]", "ru": "[Ѐ-ӿ]", "el": "[Ͱ-Ͽἀ-῿]", "ar": "[؀-ۿ]", "hi": "[ऀ-ॿ]", "th": "[฀-๿]", "ko": "[가-힯]", "he": "[֐-׿]"}
_SCRIPT = {k: re.compile(v) for k, v in _SCRIPTS.items()}


def tongue(text: str) -> str:
    """The main language of a stretch of prose; empty if it can't be told."""
    found = _WORD.findall(text)
    if sum(map(len, found)) < 4:
        return ""
    if not text.isascii():
        counts = {k: len(r.findall(text)) for k, r in _SCRIPT.items()}
        if counts["ja"] and counts["ja"] >= 0.15 * (counts["ja"] + counts["zh"]):
            counts["ja"] += counts.pop("zh")
        # ideographs carry about as much as two to three letters
        weights = {k: n * (2.5 if k in ("zh", "ja") else 1) for k, n in counts.items()}
        best = max(weights, key=weights.get)
        if weights[best] > len(_LATIN.findall(text)):
            return best
    low = [w.lower() for w in found]
    score = {k: sum(map(ws.__contains__, low)) for k, ws in _SMALL.items()}
    first, second = sorted(score.values(), reverse=True)[:2]
    return max(score, key=score.get) if first >= 2 and first > second else ""


def other_language(prompt: str, text: str, data) -> bool:
    said = prose(text, data)
    asked, given = tongue(prompt_prose(prompt)), (tongue(_QUOTED.sub(" ", said)) if data is None else "") or tongue(said)
    return bool(asked and given and asked != given)


def defect(prompt: str | None, text: str) -> str:
    """The defect of a pair apart from truncation; empty if it has none."""
    if is_empty(text):
        return "empty"
    data = _json(text)
    prompt = prompt or ""
    if is_copied(prompt, text, data):
        return "copied"
    if is_refusal(text, data):
        return "refusal"
    return "other_language" if other_language(prompt, text, data) else ""


def copied_only(prompt: str | None, text: str) -> str:
    return "copied" if is_copied(prompt or "", text, None if "{" not in text else _json(text)) else ""


def defects(texts: DataFrame) -> DataFrame:
    """``(source_table, row_id, defect, evidence)``: each defective pair once, with one defect.

    ``evidence`` is what :func:`truncation.resolve` gives for cut ends, else ``rules``.

    ``texts`` is what :func:`truncation.answers` gives. A null answer is no pair; a null or empty prompt can't be copied
    and has no language. An empty shell comes before a copy, then a refusal, then a cut end, then the language.
    """
    done = truncation.resolve(truncation.judge(texts, defect), texts)
    named = F.when(F.col("defect").isin("empty", "copied", "refusal"), F.col("defect")).when(F.col("cut"), F.lit("truncated")).otherwise(F.col("defect"))
    by = F.when(F.col("defect") == "truncated", F.col("evidence")).otherwise(F.lit("rules"))
    return done.select("source_table", "row_id", named.alias("defect"), "evidence").where("defect <> ''").withColumn("evidence", by).dropDuplicates(["source_table", "row_id"])


def cut_values(texts: DataFrame, patches: DataFrame) -> DataFrame:
    """``(source_table, row_id, relay, cut, evidence)`` of all non-empty values of problem 5; a copy of the prompt isn't cut."""
    copies = texts.select("text").unionByName(patches.select(F.col("patched").alias("text"))).unionByName(patches.select(F.col("original").alias("text")))
    done = truncation.resolve(truncation.judge(texts, copied_only), copies, truncation.cut_patches(patches))
    return done.select("source_table", "row_id", "relay", (F.col("cut") & (F.col("defect") == "")).alias("cut"), "evidence")
