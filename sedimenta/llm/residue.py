"""Template residue and error pages: unfilled slots, filler text, error and script notices.

A text is judged whole and by grammars, whatever its length: slots by one grammar a delimiter, filler
and notices by grammars over words whose slips of the pen are mended first. Code, quotes, log and
configuration lines are masked; sentences about templates or about errors are discounted by their
own words, by the sentences around them and by the density of technical marks."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.session import free_name, spread

# ---- what is running text ------------------------------------------------------------------------

_INVISIBLE = dict.fromkeys([0x200B, 0x200C, 0x2060, 0xFEFF, 0xAD])
_UNSEEN = re.compile("[\u200b\u200c\u2060\ufeff\xad]")
#: white space that is not one plain blank
_SPACES = re.compile(r"[^\S\n]{2,}|[^\S\n ]")
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_FENCE = re.compile(r"^[^\S\n]{0,3}(`{3,}|~{3,})")
_INLINE_CODE = re.compile(r"``[^`\n]+``|`[^`\n]+`")
#: An opening quote has no word before it and no blank after it, a closing one the reverse.
_QUOTED = re.compile(r'(?<![\w"])"(?=\S)[^"\n]*(?<=\S)"(?!\w)|“[^”\n]+”|«[^»\n]+»|„[^“\n]+“')
_QUOTES = re.compile(r"[\"“«„]")
_LOG_LINE = re.compile(r"^\W{0,3}(?:\[?\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}|(?:\S+ )?(?:DEBUG|INFO|WARN|WARNING|ERROR|FATAL|TRACE)\b[ :\]])")
_CONFIG_LINE = re.compile(r"^\s*(?:-\s+)?[\"']?[\w.\-/]+[\"']?\s*(?::(?:\s|$)|=)\s*(?:[\"'{\[$<%#@*\w./-]\S*(?:\s*\([^)]*\))?|\{\{.*\}\}|)\s*[,;]?\s*$")
_CODE_LINE = re.compile(
    r"^\s*(?:\{%-?\s*(?:if|for|else|elif|end\w*|set|macro|block|include|extends|import|raw|call)\b|\{#|--\s|//|/\*|#include|#!"
    r"|(?:select|from|where|with|join|left join|inner join|group by|order by|having|union|insert into|update|delete from|create (?:or replace )?(?:table|view))\b(?=.*(?:[(){}=*,]|\bas\b|$))"
    r"|(?:def|class|import|return|for|while|if|else|elif|try|except|assert|print|raise)\b.*[:(=)]\s*$|[\w.]+\s*=\s*\S|[\w.]+\(.*\)\s*;?$|[{}\[\]()]+[,;]?\s*$|[\"'][^\"']+[\"']\s*:)",
    re.IGNORECASE,
)
_TAG = re.compile(r"</?(?:p|br|div|span|hr|b|i|em|strong|center|html|head|body|title|h[1-6]|noscript|a|ul|ol|li|table|tr|td|section|main|article|footer|header|nav|script|style|meta|link|img)\b[^<>]*/?>|</\w+\s*>", re.IGNORECASE)
_MARKS = re.compile(r"[\s>#*\-•+|]*(?:\d{1,3}[.)]\s+)?[\s*_]*")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_LOOSE = re.compile(r"\s+([.,;:!?…])")
_BEFORE_POINT = re.compile(" [.,;:!?…]")


def _even(line: str) -> str:
    """``_SPACES.sub(" ", line)``."""
    if "\n" in line:
        return _SPACES.sub(" ", line)
    out = " ".join(line.split())
    if len(out) == len(line):
        return out
    return " " * line[:1].isspace() + out + " " * (bool(out) and line[-1:].isspace())


def _visible(text: str) -> str:
    return text.translate(_INVISIBLE) if _UNSEEN.search(text) else text


def text_lines(text: str) -> list[tuple[str, bool]]:
    """(line, fenced) of every line; a closing fence may be followed by text."""
    raw = text.replace("\u2028", "\n").replace("\r", "\n").split("\n")
    if "```" not in text and "~~~" not in text:
        return [(line, False) for line in raw]
    out, fence = [], None
    for line in raw:
        mark = _FENCE.match(line)
        if mark and fence is None:
            fence = mark.group(1)[0]
            out.append((line, True))
        elif mark and mark.group(1)[0] == fence:
            fence = None
            out.append((line[mark.end() :], False))
        else:
            out.append((line, fence is not None))
    return out


def running(line: str) -> str:
    """A line without inline code and quoted passages, blanks evened out; '' for log,
    configuration, code and quoted (``>``) lines."""
    line = _even(_visible(line))
    if line.lstrip().startswith(">") or _LOG_LINE.match(line) or _CONFIG_LINE.match(line) or _CODE_LINE.match(line):
        return ""
    if "`" in line:
        line = _INLINE_CODE.sub(" ", line)
    return _QUOTED.sub(" ", line) if _QUOTES.search(line) else line


def plain(line: str) -> str:
    """A line without tags, list and emphasis marks, its punctuation set close."""
    if "&" in line:
        line = html.unescape(line)
    if "<" in line:
        line = _TAG.sub(" ", line)
    line = _even(line[_MARKS.match(line).end() :].rstrip(_BLANKS + "*"))
    return _LOOSE.sub(r"\1", line) if _BEFORE_POINT.search(line) else line


# ---- slips of the pen ----------------------------------------------------------------------------

_WORDS = re.compile(r"[^\W\d_]+")
_LETTERS = bytes(c if chr(c).isalpha() and c < 128 else 32 for c in range(256))


def _words(text: str) -> list[str]:
    """``_WORDS.findall(text)``."""
    return text.encode().translate(_LETTERS).decode().split() if text.isascii() else _WORDS.findall(text)


class Speller:
    """Mends single slips in known words: two neighbouring letters swapped, also across a blank.
    ``also`` are words that are right as they stand."""

    def __init__(self, words: str, also: str = ""):
        self.words = frozenset(words.split())
        self.right = self.words | frozenset(also.split())
        self.swapped = {v: w for w in sorted(self.words) if len(w) > 2 for i in range(len(w) - 1) if (v := w[:i] + w[i + 1] + w[i] + w[i + 2 :]) not in self.right}
        #: how a known word may look
        self.looks = self.words | self.swapped.keys() | ({v for w in self.words if len(w) > 4 for v in (w[1:], w[:-1])} - self.right)

    def mend(self, low: str, words: list[str]) -> tuple[str, list[str]]:
        """A text in lower case and its words with the slips undone."""
        long = [w for w in words if len(w) > 2]
        unknown = len([w for w in long if w not in self.right])
        if not unknown or unknown * 2 > len(long) + 2:  # right, or of other matters
            return low, words
        tokens = list(_WORDS.finditer(low))
        words = [self.swapped.get(t.group(), t.group()) for t in tokens]
        for i in range(len(words) - 1):
            a, b = words[i], words[i + 1]
            if (a in self.right and b in self.right) or low[tokens[i].end() : tokens[i + 1].start()] != " ":
                continue
            for x, y in ((a + b[0], b[1:]), (a[:-1], a[-1] + b)):
                if (x in self.right or not x) and (y in self.right or not y):
                    words[i], words[i + 1] = x, y
                    break
        out, at = [], 0
        for t, w in zip(tokens, words):
            out += low[at : t.start()], w
            at = t.end()
        return "".join([*out, low[at:]]), [w for w in words if w]


# ---- unfilled slots ------------------------------------------------------------------------------

_NAME = r"[^\W\d]\w*(?:[ .\-]+\w+){0,7}"
_HTML_NAMES = r"(?:p|br|div|span|hr|b|i|u|em|strong|center|html|head|body|title|h[1-6]|noscript|a|ul|ol|li|table|tr|td|th|section|main|article|footer|header|nav|script|style|meta|link|img|code|pre|sup|sub|small)\b"
#: One alternative a delimiter; the name inside may hold letters, digits, blanks, dots and hyphens.
_SLOT = re.compile(
    "|".join(
        [
            rf"\{{\s?\{{\{{?\s*{_NAME}\s*\}}?\}}\s?\}}",
            rf"[$#]\{{\s*{_NAME}\s*\}}",
            rf"\{{%\s*(?!(?:if|for|else|elif|end|set|block|macro|include|extends|raw)\b){_NAME}\s*%\}}",
            rf"<%[=-]?\s*{_NAME}\s*%>",
            rf"\*\|\s*{_NAME}\s*\|\*",
            rf"@@\s?{_NAME}\s?@@",
            r"##\s?[^\W\d]\w*\s?##",
            r"%%?[^\W\d]\w+%%?(?!\w)(?<=%)",
            rf"%\(\s*{_NAME}\s*\)[sdr]",
            r"(?<![\w$])\$[^\W\d]\w+\$(?!\w)",
            r"(?<!\w)__(?!_)[^\W\d_]\w*?__(?![\w(])",
            r"(?<![\w~])~[^\W\d]\w+~(?![\w~])",
            rf"<<\s*{_NAME}\s*>>",
            rf"\[\[\s*{_NAME}\s*\]\]",
            rf"\(\(\s*{_NAME}\s*\)\)",
            rf"‹\s*{_NAME}\s*›",
            rf"(?<![\w\]>])<(?!/?{_HTML_NAMES})\s*{_NAME}\s*>",
            r"\[\s*(?:insert|enter|your|add|fill in|put|type|name of|write|choose|select|insira|inserir|seu|sua|digite|escreva|inserte|ingrese|escriba|su|tu|votre|saisir|insérer|ihr|ihre|bitte)\b[^\[\]\n]*\]",
            r"(?-i:\[[A-Z]{2,}(?:[_ ][A-Z]{2,})+\])",
            r"(?<![\w:]):(?:[A-Z][A-Z0-9_]{2,}|[a-z]+(?:_[a-z]+)*):(?![\w:])",
            r"(?<![\w${}\[(])\{\s*(?:[^\W\d]\w*|\d{1,2})\s*\}(?![\w{}\])])",
        ]
    ),
    re.IGNORECASE,
)
#: Every alternative of ``_SLOT`` starts with one of these; ``&`` may be an escaped one.
_OPENS = re.compile(r"\{|%[%(\w]|‹|&[#a-z]|<[%<\s\w]|\*\||@@|##|\$\w|__|~\w|\[[\[\s\w]|\(\(|:[A-Za-z]")
#: The places at which one of them can start.
_STARTS = re.compile(rf"(?={_OPENS.pattern}|[$#]\{{|:\w)")


def _slot(text: str) -> re.Match | None:
    """``_SLOT.search(text)``."""
    return next((found for at in _STARTS.finditer(text) if (found := _SLOT.match(text, at.start()))), None)


#: Signs that stand for no value. The weak ones are words that technical text uses as well.
_STRONG = r"_{3,}|x{4,}|tbd|tba|tbc|nan|\(null\)|\[object object\]|#n/a|\?{3,}|<null>|<none>"
_WEAK = r"none|null|nil|undefined|n/a"
_ANY_SIGN = re.compile(rf"___|xxxx|\btb[dac]\b|\bn(?:an|ull|il|one|/a)\b|\bundefined\b|\[object |\?\?\?", re.IGNORECASE)
#: Words of which each sign that is a word has one (``n/a`` falls apart into letters).
_SIGN_WORDS = frozenset("tbd tba tbc nan none null nil undefined object n".split())
#: Positions in which a sentence needs a name or value (English, Portuguese, Spanish, French, German).
_GREETING = r"hello|hi|dear|welcome|thanks,?|regards,?|olá|ola|prezad[oa]s?|car[oa]s?|hola|estimad[oa]s?|gracias,?|obrigad[oa],?|bonjour|chère?s?|hallo|liebe[rs]?"
_PREPOSITION = r"for|of|by|on|at|about|from|with|until|since|named|called|por|em|no|na|de|do|da|para|sobre|com|con|en|del|desde|até|hasta|pour|par|chez|von|für|am|über"
_TOWARDS = r"(?:welcome|write|talk|speak|sent|send|belongs?|addressed|assigned|reply|escreva|escriba|bem-?vind[oa]s?|bienvenid[oa]s?|envi\w+|ligue|llame) (?:to|a|ao|à|al)"
_NOUN = r"(?:the|this|that|your|our|my|its|their|team|o|a|os|as|el|la|los|las|su|sus|sua|seu|nossa|nosso|nuestr[oa]|le|les|votre|der|die|das|ihre?) (?!(?:values?|strings?|literals?|words?|keywords?|types?|fields?|results?|constants?|tokens?|defaults?|is|was|returned|same|valor|tipo|palavra|palabra|cadena|campo|cadeia|texto)\b)[^\W\d_]+"
_VERB = r"(?:page|document|guide|article|section|note|report|letter|chapter) (?!(?:returns|contains|holds|has|is|becomes|gives|yields|means|allows|accepts|stores|leaves|gets|sends|shows|reads|says|was|stored|returned)\b)[^\W\d_]+s|(?:we|you|they|nós|nosotros|wir|nous) (?!(?:are|were|have|get|got|see|saw|store|stored|return|returned|treat|use|used|write|wrote|read|expect|allow|call|called|keep|kept|need)\b)[^\W\d_]+"
_GERUND = r"(?:for|on|by|in) [^\W\d_]{2,}ing|(?:por|al) [^\W\d_]{2,}(?:[aei]r|ndo)"
_PLACE = rf"(?:{_GREETING}|{_PREPOSITION}|{_TOWARDS}|{_NOUN}|{_VERB}|{_GERUND})"
_NO_VALUE = re.compile(rf"(?<![\w-])(?:{_PLACE})\s+(?:{_STRONG}|{_WEAK})(?![\w-])|(?<![\w-])el (?:{_STRONG}|{_WEAK})(?=\s*(?:[.,;!?]|$))", re.IGNORECASE)
_STRONG_VALUE = re.compile(rf"(?<![\w-])(?:{_PLACE})\s+(?:{_STRONG})(?![\w-])", re.IGNORECASE)
_RULE_SIGN = re.compile(r"(?<![\w_])(?:_{3,}|[xX]{4,})(?![\w_])")
#: Speaking of slots: templates and their parts, and what fills them.
_SPEAKS = re.compile(
    r"\b(?:placeholders?|slots?|templat\w+|mustache|handlebars|jinja|liquid|syntax|brackets?|braces?|delimiters?|generics?|engine|render\w*|interpolat\w+|substitut\w+|replaced (?:by|with)|filled (?:in )?(?:by|with)|fills? (?:it|them) in|"
    r"stands? for|merge (?:tags?|fields?)|variables?|literals?|strings?|type as|came back as|stored? as|counts? as|leaves?|refused|deixa|plantillas?|modelo de texto|texto do modelo|variável|variáveis|marcador\w*|gabarits?|platzhalter|vorlagen?)\b",
    re.IGNORECASE,
)
#: An instruction to write the slot itself.
_SHOWS = re.compile(r"\b(?:write|use|type|put|like|such as|e\.g\.|for example|called|named|named as|the (?:tag|token|marker|macro)|escreva|use o|escriba|por exemplo|por ejemplo|par exemple|zum beispiel|z\. ?b\.)\s*:?\s*$", re.IGNORECASE)
#: Speaking of missing values as data.
_OF_VALUES = re.compile(r"\b(?:values?|keys?|fields?|columns?|types?|missing|absent|instead|default\w*|cast\w*|pars\w*|return\w*|stor\w*|treat\w*|handl\w*|convert\w*|compar\w*|check\w*|campos?|colun?as?|columnas?|claves?|chaves?|valor\w*|tipos?|wert\w*|valeurs?)\b", re.IGNORECASE)
_TECHNICAL = re.compile(r"`[^`]*`|\b\w+_\w+\b|\b[a-z]+[A-Z]\w*|\w+\(\)|[{}<>$%@#|=;\\]|\w/\w|::|->")


def _explained(sentence: str, before: str, after: str) -> bool:
    """The sentence shows or explains its slot: it speaks of templates; or it tells to write the slot
    and it or a sentence beside it does; or those beside it do and technical marks are dense in it."""
    if _SPEAKS.search(sentence):
        return True
    around = bool(_SPEAKS.search(before) or _SPEAKS.search(after))
    if not around:
        return False
    slot = _slot(sentence)
    if slot and _SHOWS.search(sentence[: slot.start()]):
        return True
    bare = _SLOT.sub(" ", sentence)
    return len(_TECHNICAL.findall(bare)) * 3 >= max(1, len(_WORDS.findall(bare)))


def has_slot(lines: list[tuple[str, bool]], tokens: list[list[str]] | None = None) -> bool:
    """An unfilled slot, or one filled with a sign of no value, in a running sentence that is not
    explained by itself or its surroundings. ``tokens``, the words of each line in lower case, only
    spare lines without a sign."""
    before = ""
    for n, (raw, fenced) in enumerate(lines):
        if fenced or not raw:
            continue
        signs = tokens is None or not _SIGN_WORDS.isdisjoint(tokens[n]) or "___" in raw or "???" in raw or "xxxx" in raw.lower()
        if not signs and not _OPENS.search(raw):
            continue
        line = running(raw)
        if not line:
            continue
        if "&" in line:
            line = html.unescape(line)
        if not _slot(line) and not (signs and _ANY_SIGN.search(line)):
            continue
        sentences = _SENTENCE.split(line)
        # the sentences beside a line are in the lines beside it
        before = next((x for x, f in reversed(lines[max(0, n - 2) : n]) if x.strip()), "")
        behind = next((x for x, f in lines[n + 1 : n + 3] if x.strip()), "")
        for i, sentence in enumerate(sentences):
            slot = _slot(sentence)
            if not slot and not _ANY_SIGN.search(sentence):
                continue
            left = sentences[i - 1] if i else before
            right = sentences[i + 1] if i + 1 < len(sentences) else behind
            if slot and not _explained(sentence, left, right):
                return True
            if _SPEAKS.search(sentence):
                continue
            if _STRONG_VALUE.search(sentence) or (_NO_VALUE.search(sentence) and not _OF_VALUES.search(sentence)):
                return True
            if _RULE_SIGN.search(sentence):
                bare = _RULE_SIGN.sub(" ", sentence)
                if re.search(r"[^\W\d_]{2,}", bare) and not re.search(r"[=~*#-]{3}", bare):
                    return True
    return False


# ---- filler --------------------------------------------------------------------------------------

#: The words of the usual dummy Latin.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo "
    "consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_LATIN_SURE = LATIN - frozenset("do in ad ex id non sit est ut et ea eu sed qui dolor magna".split())
#: Keyboard drumming: letters of one row only, without the look of a word.
_KEYS = re.compile(r"^(?:[asdfghjkl]{3,}|[qwertyuiop]{5,}|[zxcvbnm]{4,}|asdf\w*|qwert\w*)$")
_NOT_KEYS = frozenset("all ask add dash data fall false flag flash gas glad glass had half hall has hash lag lash salad sad shall slash property require pretty poetry query report reporter tree type try were quit quite power pipe prior outer quote write wrote writer root your you top tower route error territory priority repository typewriter".split())
_REPEAT = re.compile(r"\b(\w[\w' ]{1,60}\w)\b[\s.,;!…]+(?:\1\b[\s.,;!…]*){2,}")
_FILL_WORD = r"(?:placeholder|dummy|sample|filler|example|lorem|test|blah|text|texto|exemplo|ejemplo|relleno|preenchimento|teste|prueba|bla)"
_THING = r"(?:text|content|contents|copy|paragraph|description|summary|title|heading|caption|section|page|body|note|words)"
_COISA = r"(?:texto|conteúdo|contenido|parágrafo|párrafo|descrição|descripción|resumo|resumen|título|seção|sección|página|nota)"
_HERE = r"(?:here|aqui|aquí)"
#: What fillers say, after mending; each alternative is a whole sentence.
_FILLER = re.compile(
    "|".join(
        [
            # asking the author for the text
            rf"(?:please )?(?:insert|add|write|type|enter|put|place|paste|provide)\b(?: \w+){{0,8}}? {_THING}\b(?: \w+){{0,8}} {_HERE}|(?:please )?(?:insert|add|write|type|enter|put|place|paste|provide)\b(?: \w+){{0,3}}? {_THING} {_HERE}",
            rf"(?:replace|edit|change)\b(?: this| the| that) {_THING}\b (?:with|by|to)\b(?: \w+){{1,8}}",
            rf"(?:click|tap|double[- ]click)(?: here)? to (?:edit|add|change|write)\b(?: \w+){{0,8}}",
            rf"(?:your|the) (?:\w+ )?{_THING}s? (?:goes|go|comes|belongs|will go|will appear|should go)(?: \w+){{0,3}}",
            r"(?:type|write|enter|say) (?:something|anything|here)(?: here)?",
            rf"(?:insira|escreva|digite|adicione|coloque)\b(?: \w+){{0,4}}? {_HERE}(?: \w+){{0,6}}|(?:inserte|escriba|escribe|ingrese|añada|agregue|ponga)\b(?: \w+){{0,4}}? {_HERE}(?: \w+){{0,6}}",
            rf"(?:insira|escreva|digite|adicione|coloque|inserte|escriba|escribe|ingrese|añada|agregue|ponga)\b(?: \w+){{0,6}}? {_COISA}\b(?: \w+){{0,6}} {_HERE}",
            rf"(?:substitua|edite|troque|reemplace|sustituya|cambie)\b (?:este|esta|o|a|el|la) {_COISA}(?: \w+){{0,6}}|(?:clique|haga clic)(?: \w+){{0,3}} para (?:editar|escrever|escribir)(?: \w+){{0,6}}",
            rf"(?:o |el )?(?:seu |su )?{_COISA} (?:vai|fica|va|irá) {_HERE}",
            # announcing it
            r"(?:to be|yet to be|will be) (?:written|added|completed|filled in|defined|done|determined|decided|continued|announced|translated)(?: later| soon)?",
            rf"(?:(?:more |the )?(?:content|text|details?|description|documentation|more|information|{_THING}) )?(?:is |are )?coming soon",
            r"(?:this |the |our )?(?:page|section|chapter|site|article|document) (?:is )?(?:still |currently )?under construction",
            r"(?:this )?page (?:is |was )?(?:intentionally|deliberately) (?:left )?(?:blank|empty)",
            rf"(?:no )?{_THING} (?:is )?(?:not (?:yet )?(?:available|written|provided|added)|unavailable|missing)(?: yet)?|no {_THING} (?:yet|available)(?: yet)?",
            r"todo|tbd|tba|tbc|fixme|placeholder|wip|work in progress",
            rf"(?:el |o )?{_COISA} (?:em breve|disponível em breve|próximamente|disponible próximamente|disponible en breve)|(?:em breve|próximamente|muy pronto)(?: mais| más)?(?: conteúdo| contenido)?",
            r"(?:esta |a |la )?(?:página|seção|sección|site|sitio) (?:está )?(?:em|en) (?:construção|construcción)",
            r"(?:esta )?página (?:deixada|dejada) (?:em|en) (?:branco|blanco)(?: \w+)*",
            r"(?:a|por) (?:escrever|completar|definir|preencher|escribir|rellenar)",
            rf"{_COISA} (?:ainda )?(?:não|no) (?:está )?(?:disponível|disponible)(?: ainda| todavía| aún)?",
            # naming itself
            rf"(?:{_FILL_WORD}[ .,!…]+){{1,}}{_FILL_WORD}|{_FILL_WORD} (?:de|for|of) {_FILL_WORD}(?:[ .,!…]+{_FILL_WORD} (?:de|for|of) {_FILL_WORD})*",
            r"(?:lorem ipsum\W*)+(?:dolor.*)?",
        ]
    ),
)
#: Words one of which every filler sentence has.
FILLER_ANCHORS = (
    "insert add write type enter put place paste provide replace edit change click tap goes comes belongs something anything here insira escreva digite adicione coloque inserte escriba escribe ingrese añada agregue ponga substitua edite troque reemplace "
    "sustituya cambie clique clic vai fica va irá written added completed filled defined done determined decided continued announced translated coming soon construction blank empty available provided unavailable missing yet todo tbd tba tbc fixme "
    "placeholder wip progress breve próximamente pronto construção construcción branco blanco escrever completar definir preencher escribir rellenar disponível disponible dummy sample filler example lorem test blah text texto exemplo ejemplo relleno "
    "preenchimento teste prueba bla aqui aquí conteúdo contenido"
)
_FILLER_MORE = "this the your own with and paragraph content contents description summary section title heading caption page body note words copy short to be is are still currently under intentionally deliberately left not no of for de o a el la seu su este esta em en parágrafo párrafo descrição descripción resumo resumen título seção sección página nota pelo por double more details documentation information ipsum dolor"
FILLER_SPELLER = Speller(" ".join([FILLER_ANCHORS, _FILLER_MORE, *sorted(LATIN)]), "form from text next cite tide trail them then")
_FILLER_LOOKS = Speller(FILLER_ANCHORS).looks | _LATIN_SURE
_FILL_SET = frozenset(_FILL_WORD[3:-1].split("|"))


@lru_cache(maxsize=1 << 16)
def _drummed(word: str) -> bool:
    return word not in _NOT_KEYS and _KEYS.match(word) is not None


def _is_dummy(words: list[str]) -> bool:
    """Dummy Latin or keyboard drumming: most words of a line, or a run of eight within it."""
    if len(words) >= 4:
        latin = sum(w in LATIN for w in words)
        if latin >= 0.6 * len(words) and sum(w in _LATIN_SURE for w in words) >= 2:
            return True
        if sum(map(_drummed, words)) >= 0.6 * len(words):
            return True
    run = sure = 0
    for w in words:
        if w in LATIN:
            run, sure = run + 1, sure + (w in _LATIN_SURE)
            if run >= 8 and sure >= 4:
                return True
        else:
            run = sure = 0
    return False


def _thrice(words: list[str]) -> bool:
    """A word of three letters comes three times at one distance, as it does where ``_REPEAT`` finds
    letters repeated: a repetition has at most 62 characters, so 31 words."""
    places = defaultdict(list)
    for i, w in enumerate(words):
        if len(w) >= 3:
            places[w].append(i)
    for at in places.values():
        if len(at) >= 3:
            there = set(at)
            if any(2 * j - i in there for n, i in enumerate(at) for j in at[n + 1 : n + 32] if j - i <= 31):
                return True
    return False


def _filler_line(raw: str) -> bool:
    text = plain(running(raw)).lower()
    if not text:
        return False
    low, words = FILLER_SPELLER.mend(text, _words(text))
    different = set(words)
    if (not different.isdisjoint(_LATIN_SURE) or any(map(_drummed, different))) and _is_dummy(words):
        return True
    filling = not different.isdisjoint(_FILL_SET)
    if len(words) >= 3 and (len(different) * 2 <= len(words) or (filling and len(different) + 2 <= len(words))):
        hit = _thrice(words) and _REPEAT.search(low)
        if hit and hit.end() - hit.start() >= 9 and re.search(r"[^\W\d_]{3}", hit.group(1)):
            return True
    if different.isdisjoint(FILLER_SPELLER.words):
        return False
    sentences = _SENTENCE.split(low)
    if len(sentences) > 1:
        sentences.append(low)
    return any(_FILLER.fullmatch(s.strip(" .!…*:;-")) for s in sentences)


def has_filler(lines: list[tuple[str, bool]], tokens: list[list[str]] | None = None) -> bool:
    """A line or sentence that is nothing but filler. ``tokens``, the words of each line in lower
    case, only spare lines that cannot be: every filler has an anchor word or a slip of one, a sure
    word of dummy Latin, drumming, or few different words."""
    drums = tokens is not None and any(map(_drummed, set().union(*tokens)))
    for (line, fenced), own in zip(lines, tokens if tokens is not None else [None] * len(lines)):
        if fenced:
            continue
        if own is not None:
            if not own:
                continue
            there = set(own)
            if there.isdisjoint(_FILLER_LOOKS) and len(there) * 3 > len(own) * 2 and not (drums and any(map(_drummed, there)) and sum(map(_drummed, own)) * 5 >= len(own) * 3):
                continue
        if _filler_line(line):
            return True
    return False


# ---- error and notice pages ----------------------------------------------------------------------

_REASON = (
    r"bad request|unauthori[sz]ed|payment required|forbidden|not found|method not allowed|not acceptable|request time-?out|conflict|gone|too many requests|unavailable for legal reasons|internal server error|"
    r"not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|http version not supported|bandwidth limit exceeded"
)
_SCRIPT = r"(?:javascript|java script|scripts?|scripting|skripte?|cookies?)"
_NAVIGATOR = r"(?:browsers?|navegador|navigateur)"
_SWITCH = (
    r"(?:enabled?|enabling|allow(?:ed|s)?|activated?|turn(?:ed)? o(?:n|ff)|switch(?:ed)? o(?:n|ff)|must be (?:on|no(?=\W*$))|disabled?|blocked|requires?|required|needs?|needed|permit(?:ted|s)?|support(?:ed|s)?|available|"
    r"does not run|doesn't run|won't work|will not work|ative|ativar|ativado|habilite|habilitar|habilitad[oa]s?|bloquead[oa]s?|desativad[oa]s?|precisa|precisam|permita|permite|necessári[oa]s?|requer|"
    r"active|activar|activad[oa]s?|desactivad[oa]s?|necesita|necesari[oa]s?|requiere|compatible|compatível|"
    r"activer|activez|activé|désactivés?|autoriser|autorisez|nécessaires?|requis|nécessite|aktivieren|aktiviert|deaktiviert|erlauben|benötigt|erforderlich|zulassen)"
)
_PLACE_WORD = r"(?:server|service|site|website|page|host|proxy|portal|app|application|system)"
#: What the sentences of an error page or notice say, in lower case, after mending: (words of which each alternative has one, pattern).
NOTICES: list[tuple[str, str]] = [
    # status lines
    (
        "bad unauthorized unauthorised payment forbidden found method acceptable request timeout conflict gone many unavailable internal implemented gateway service http bandwidth error erro erreur fehler código codigo status code err",
        rf"\b[45]\d\d\b\W{{0,4}}(?:error\W+)?(?:{_REASON})|^(?:error\W+)?(?:{_REASON})\W*$|[\"'>](?:{_REASON})[\"'<]|(?:{_REASON})\b.{{0,12}}\b(?:error|code)?\W*[45]\d\d\b"
        r"|^(?:http )?(?:error|erro|erreur|fehler|código|codigo|status|code)(?: code| de erro| de error)?\W{0,3}\d{3}\b|\berror code\b|\bcódigo \d{3}\b|\berr_[a-z_]{4,}",
    ),
    # failures of a program
    (
        "error erro erreur fehler serverfehler traceback trace stacktrace file exception uncaught fault exhausted",
        r"\b(?:internal|unexpected|unknown|fatal|critical|application|server|runtime|parse) (?:server )?error\b|\berror interno\b|\berro interno\b|\berror inesperado\b|\berro inesperado\b|\berreur interne\b|\binterner (?:server)?fehler\b"
        r"|\btraceback\b|^file \W?/?\S+, line \d+|\b[a-z]+(?:error|exception)\b:|\bstack ?trace\b|\bunhandled exception\b|\buncaught\b|\bsegmentation fault\b|\bmemory (?:size |limit )?(?:of \d+ bytes )?exhausted\b",
    ),
    # something cannot be had
    (
        "server service site website page host proxy portal app application system reached find connect displayed shown found loaded reach connection request session operation gateway wrong oops uh page link address resource longer página seite servicio serviço sitio dienst temporalmente",
        rf"\b{_PLACE_WORD}\b.{{0,25}}\b(?:could|can(?:no|')?t|did|does|is|was|has) ?(?:not|n't)? (?:complete|be reached|respond|handle|process|available|found|displayed|down|reachable|offline|moved)\b"
        r"|\bcan(?:no|')?t (?:be reached|find (?:the|that)|connect|be (?:displayed|shown|found|loaded))|\bcannot be (?:displayed|shown|reached|found|loaded)|\bcould not (?:be (?:found|reached|loaded|displayed)|reach the|connect to)"
        r"|\b(?:connection|request|session|operation|gateway) (?:was |has |is )?(?:reset|refused|timed? ?out|closed|expired|aborted)\b"
        r"|\bsomething went wrong\b|^oops\b|^uh[- ]oh\b|\bwent wrong on our (?:side|end)|\b(?:page|link|address|resource) .{0,30}\bdoes(?:n't| not) exist\b|\bpage (?:you|not)\b.{0,25}\b(?:looking for|requested|found)\b|\blink (?:seems to be|is|may be) broken\b|\bbroken link\b"
        r"|\bpage (?:took|is taking|is on) (?:a |its )?(?:day off|break|holiday|vacation)\b|\bno longer (?:available|exists)\b|\bsite offline\b"
        r"|\bpágina no encontrada\b|\bpágina não encontrada\b|\bpage (?:non trouvée|introuvable)\b|\bseite (?:wurde )?nicht gefunden\b"
        r"|\b(?:servicio|serviço|sitio|site|service|dienst)\b.{0,25}\b(?:no disponible|indisponível|fora do ar|fuera de servicio|offline|indisponible|nicht verfügbar)\b|\btemporalmente fuera\b",
    ),
    # rights, sessions, limits
    (
        "access acceso acesso accès zugriff permission authorized authorised allowed permiso permissão rate requests solicitudes peticiones solicitações requisições requêtes anfragen slow session sign login log logged sessão sesion sesión sitzung inactivity",
        r"\baccess (?:is |was )?(?:denied|forbidden|restricted)\b|\bacceso denegado\b|\bacesso negado\b|\baccès refusé\b|\bzugriff verweigert\b|\b(?:do not|don't) have (?:permission|access)\b|\bnot (?:authori[sz]ed|allowed) to\b|\bsin permiso\b|\bsem permissão\b"
        r"|\brate limit(?:ed)?\b|\btoo many requests\b|\bdemasiadas (?:solicitudes|peticiones)\b|\bmuitas (?:solicitações|requisições)\b|\btrop de requêtes\b|\bzu viele anfragen\b|\bslow down\b"
        r"|\bsession\b.{0,20}\b(?:expired|ended|timed out)\b|\b(?:sign|log) ?in (?:again|to|is required|required)\b|\blog-?in required\b|\blogged out\b|\bsess(?:ão|ion|ión)\b.{0,20}\bexpir|\bsesi[oó]n\b.{0,20}\b(?:caducad|expirad)|\bsitzung\b.{0,20}\babgelaufen\b|\binicie sesi[oó]n\b|\bfaça login\b|\bdue to inactivity\b|\bplease (?:sign|log) in\b",
    ),
    # maintenance, and what to do now
    (
        "maintenance manutenção mantenimiento wartungsarbeiten updated back returns voltamos volvemos again novamente novo inténtelo intentelo inténtalo intentalo réessayez erneut administrator volte vuelva versuchen",
        r"\bmaintenance\b|\bmanutenção\b|\bmantenimiento\b|\bwartungsarbeiten\b|\b(?:site|service)\b.{0,20}\bbeing updated\b|\bbe (?:right )?back\b|\bservice returns\b|\bvoltamos\b|\bvolvemos\b"
        r"|\btry again\b|\btente (?:novamente|de novo)\b|\bint[eé]nt[ea]lo\b|\bréessayez\b|\bversuchen sie es\b|\bcontact the administrator\b|\bcheck back\b|\bgo back to\b|\bvolte (?:para|à)\b|\bvuelva al?\b",
    ),
    # scripts and cookies: together with a word of switching
    (
        "javascript java script scripts scripting skript skripte cookie cookies",
        rf"\b{_SWITCH}\b",
    ),
    # browsers, together with what is wrong with them; checks
    (
        "browser browsers navegador navigateur",
        r"\b(?:not supported|out of date|outdated|unsupported|não é compatível|no es compatible|no permite|bloquead\w+|does not (?:run|support))\b|\bchange your browser\b|\bcannot be shown in\b|\bcurrent browser\b|\bbrowser settings\b|\bupgrade your browser\b",
    ),
    (
        "browser navegador navigateur version human robot moment step robô verifying",
        rf"^(?:please )?upgrade to a\b.*\bversion\b|\bchecking your {_NAVIGATOR}|\bverifying (?:that )?you are|\bare you (?:a )?(?:human|robot)|\bnot a robot\b|\bjust a moment\b|\bverific(?:ando|amos)\b.{{0,30}}\b{_NAVIGATOR}|\bno es un robot\b|\bnão é um robô\b|\bone more step\b",
    ),
    # waiting and switching on
    (
        "please recarregue cargar enable habilite active ative actívelo actívelos activelo activelos nothing nada loading carregando cargando chargement",
        r"\bplease (?:wait|upgrade|enable|change|reload|refresh)\b|\brecarregue\b|\bvuelva a cargar\b|\benable (?:it|them) (?:and|to)\b|\b(?:habilite|ative|active)-(?:o|a|os|as)\b|\bact[ií]vel[oa]s?\b|\bif nothing happens\b|\bse nada acontecer\b|\bsi no (?:pasa|ocurre) nada\b|^(?:loading|carregando|cargando|chargement)\b",
    ),
]
_NOTICE_GROUPS = [re.compile(p) for _, p in NOTICES]
_GROUP_OF: dict[str, tuple[int, ...]] = {w: tuple(i for i, (words, _) in enumerate(NOTICES) if w in words.split()) for words, _ in NOTICES for w in words.split()}
#: a program's own error names, such as KeyError
_ERROR_NAME = re.compile(r"[a-z]+(?:error|exception)$")
_ENDS_ERROR = re.compile(r"error\b|Error\b|ERROR\b|xception\b|XCEPTION\b")


def _says_notice(low: str, words: list[str]) -> bool:
    groups = {g for w in words for g in _GROUP_OF.get(w, ())}
    if ("error" in low or "exception" in low) and any(_ERROR_NAME.match(w) for w in words):
        groups.add(1)
    return any(_NOTICE_GROUPS[g].search(low) for g in groups)


#: Neutral remainders of such pages: references, thanks, server names, what follows from the notice.
_NEUTRAL = re.compile(
    r"^(?:(?:reference|request id|incident|event id|ray|ray id|trace id|trace|id|code|código)\b\W*[\w-]*|[0-9a-f-]{6,}|[\w.-]+/\d[\w.]*|[a-z]+(?:-[a-z]+)+|thank you\b.*|thanks\b.*|obrigad[oa]\b.*|gracias\b.*|merci\b.*|(?:we(?:'|’)?re )?sorry\b.*|"
    r"this may take\b.*|isso pode\b.*|esto puede\b.*|.*\bwill not work\b.*|[\W_]*(?:(?:html|head|body|title|center|hr|div|span|br|p|h[1-6])[\W_]*)+|(?:this|the) (?:site|page|app\w*) needs (?:it|them)\b.*|\d+|[\W_]+)$"
)
#: Telling about errors: speech, habits and reactions of clients. Such a sentence makes the text a report.
_REPORTS = re.compile(
    r"\b(?:says|said|reads?|dizia|decía|disse|dijo|answer(?:s|ed)|repl(?:y|ies|ied)|return(?:s|ed)|rais(?:es|ed)|retr(?:y|ied|ies)|(?:was|were|is|are|we|it) (?:logged|stored|kept|recorded)|stored it|we (?:keep|store|saw|log|noticed)|guardou|guardó|"
    r"usually|often means|which (?:is|means)|some (?:users|people|clients|pages)|works? without|funciona sem|funciona sin|except for|only for|so that|for example|por exemplo|por ejemplo|salvo|exceto|excepto|menos na|when (?:the|an?|our|access|requests?)|quando (?:a|o|as|os|uma?)|cuando (?:el|la|los|las|una?)|si la|si el|se a|se o)\b"
)
#: A reporting clause that notices have as well.
_NOT_REPORTS = re.compile(r"\bservice returns\b|\bpage .{0,12}returned\b")
#: Words of notices beside the anchors, as they are spelt.
_NOTICE_MORE = (
    "unexpected unknown fatal critical runtime memory size limit limited bytes unhandled segmentation could cannot can not complete respond handle process available reachable offline moved down reset refused closed expired aborted timed out went something our side end looking requested "
    "does exist seems broken took day off encontrada disponible indisponível fuera denied denegado negado restricted have resource too network demasiadas muitas been ended required inicie faça due view content being right tente para inicial página inicio later more tarde más mais tarde "
    "contact check few minutes home the that this your you for from are was has with and must permit permitted permite enabled disabled switched turned activated blocked requires needs run work supported compatible compatível desativado bloqueados necesita requiere precisa funcionar usar aplicación continuar prosseguir "
    "document display active parts website upgrade recent shown current change settings checking before continue wait take seconds happens allow reload acontecer scripts thank patience sorry portal properly without server code request interno del servidor interno scheduled name object iterable database line render trace recarregue página seu los may take reference request id incident event ray trace works al não just try we're"
)
NOTICE_SPELLER = Speller(" ".join([*(w for words, _ in NOTICES for w in words.split()), _NOTICE_MORE]), "fro form aws trial trail quiet sue use united untied steer serve sever marital being begin on no on in is it as at an of or to be a o e y en no em do da de")
_NOTICE_LOOKS = Speller(" ".join(w for words, _ in NOTICES for w in words.split())).looks
_NAV_WORDS = re.compile(
    r"^(?:back to top|was this page helpful|yes|no|privacy|terms|contact|menu|search|sign in|sign up|log in|home|docs|documentation|help|about|skip to (?:main )?content|política de privacidade?|termos|contato|inicio|início|buscar|ayuda|"
    r"all rights reserved|share|print|edit this page|next|previous|api|status|guides|pricing|blog|support|legal|cookies policy|voltar ao topo|volver arriba|accueil|startseite|impressum)[?.:]?$",
    re.IGNORECASE,
)
_NAV_ONLY = re.compile(r"(?:menu|search|home|docs|sign|in|up|log|api|help|login|blog|about|contact|privacy|terms|yes|no|buscar|inicio|início|entrar|[/|·])+", re.IGNORECASE)
_NAV_START = re.compile(r"^(?:©|\(c\) ?\d|copyright\b|≡|☰)", re.IGNORECASE)
_NAV_SPLIT = re.compile(r" [|·/>›»•] |\? ")
_NAV_MARK = re.compile(r"[|·/>›»•?]")
_NOT_LINK = re.compile(r"[.!:;…]|\d{3}")


def is_navigation(line: str) -> bool:
    """Site furniture of any length: link rows, breadcrumbs, copyright and feedback lines; a link
    has at most four words."""
    text = plain(line.replace("\xa0", " "))
    if _NAV_START.match(text) or _NAV_WORDS.match(text):
        return True
    words = text.split()
    parts = _NAV_SPLIT.split(text) if len(words) > 1 and _NAV_MARK.search(text) else []
    if len(parts) >= 2 and len(words) <= 5 * len(parts) and all(len(p.split()) <= 4 and not _NOT_LINK.search(p) for p in parts):
        return True
    return len(words) >= 2 and all(map(_NAV_ONLY.fullmatch, words))


def _is_error_object(body: str) -> bool:
    """An API's error object."""
    if re.search(r"\"(?:data|items|orders|results)\"\s*:", body) or not re.search(r"\"(?:error|status|message|code|errors|detail)\"\s*:", body):
        return False
    return bool(_says_notice(body, _WORDS.findall(body)) or re.search(r"\"(?:error|status|code)\"\s*:\s*\{?\W*(?:\"?code\"?\W*)?\"?[45]\d\d", body))


_TRACE = re.compile(r"^file \W?[^\"]+\W?, line \d+")
_STAMPED = re.compile(r"^\W{0,3}\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")
_BREAK = re.compile(r"<br\s*/?>|</(?:p|h[1-6]|div|li|title|td)>", re.IGNORECASE)
_ENDS = (". ", "! ", "? ", "… ", ".\xa0", "!\xa0", "?\xa0")


def is_error_page(text: str, lines: list[tuple[str, bool]] | None = None, tokens: list[list[str]] | None = None) -> bool:
    """Apart from navigation, nothing but an error message or notice. All sentences count: for each
    that is neither notice nor neutral remainder there must be three notices (one, if it is made of
    the words of notices, as a slip of the pen leaves it), and none may report on errors. Fenced
    and log lines are content. ``lines`` and their ``tokens``: as the caller has
    them already."""
    if lines is None or "<" in text:
        lines = text_lines(_BREAK.sub("\n", text))
        tokens = None
    if tokens is None:
        tokens = [_words(line.lower()) for line, _ in lines]
    # no text has more notices than sentences in lines with a word of notices: the walk ends where these cannot tip the balance
    most = 0
    for (line, _), own in zip(lines, tokens):
        if own and (not _NOTICE_LOOKS.isdisjoint(own) or _ENDS_ERROR.search(line)) and not _STAMPED.match(line):
            most += 1 + sum(map(line.count, _ENDS))
    if not most:
        return False
    hits = near = content = 0
    data: list[str] | None = None
    source_line = False
    for (line, fenced), own in zip(lines, tokens):
        if not line or line.isspace():
            continue
        if fenced:
            content += 1
        elif data is None and content and own and _NOTICE_LOOKS.isdisjoint(own) and not _ENDS_ERROR.search(line) and line[0] not in "{[" and not is_navigation(line):
            content += sum(not _NEUTRAL.match(x.strip(" .!*-#").lower()) for x in _SENTENCE.split(plain(_visible(line))) if x.strip(" .!*-#"))
            source_line = False
        else:
            if is_navigation(line):
                continue
            unit = plain(_visible(line))
            if not unit:
                continue
            if data is None and not hits and not content and unit[0] in "{[":
                data = []
            if data is not None:
                data.append(unit.lower())
                continue
            if source_line:  # the line of code a traceback names
                source_line = False
                continue
            if _STAMPED.match(unit):
                content += 1
                continue
            for sentence in _SENTENCE.split(unit):
                sentence = sentence.replace("’", "'").strip(" *-")
                if not sentence:
                    continue
                low = sentence.lower()
                words = _words(low)
                found = _says_notice(low, words)
                if not found:
                    mended, words = NOTICE_SPELLER.mend(low, words)
                    if mended is not low:
                        low = mended
                        found = _says_notice(low, words)
                if (found or content) and _REPORTS.search(low) and not _NOT_REPORTS.search(low):
                    return False
                if found:
                    hits += 1
                    source_line = bool(_TRACE.match(low))
                elif not _NEUTRAL.match(low.strip(" .!")):
                    known = len([w for w in words if w in NOTICE_SPELLER.words])
                    if known * 5 >= len(words) * 3 and words:
                        near += 1
                    else:
                        content += 1
        if content * 3 > max(most, hits):
            return False
    if data is not None:
        return _is_error_object(" ".join(data))
    return hits > 0 and content * 3 <= hits and near <= hits


def residue_kinds(text: str | None) -> list[str]:
    """Which of ``slot``, ``filler``, ``error_page`` a text is; none for null, empty or blank."""
    if text is None or not text.strip():
        return []
    lines = text_lines(text)
    tokens = [_words(line.lower()) for line, _ in lines]
    kinds = []
    if has_slot(lines, tokens):
        kinds.append("slot")
    if has_filler(lines, tokens):
        kinds.append("filler")
    if is_error_page(text, lines, tokens):
        kinds.append("error_page")
    return kinds


def detect_residue(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kinds) of each row's whole text; ``kinds`` is an empty list for clean, null, empty and
    blank texts. Repeated keys give a row each. Map-only but for ``spread``."""
    kind, kinds = df.schema[key].dataType.simpleString(), free_name([key], "kinds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [residue_kinds(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["k", "kinds"])

    return spread(df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))).mapInArrow(run, f"k {kind}, kinds array<string>").toDF(key, kinds)


def without_residue(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text has no residue, with all their columns; null, empty and blank texts
    stay. One pass: the verdict travels with the row, nothing is joined."""
    verdict = free_name(df.columns, "__residue")
    schema = T.StructType([*df.schema.fields, T.StructField(verdict, T.BooleanType())])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([bool(residue_kinds(t.as_py())) for t in batch.column(at)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, verdict])

    return spread(df).mapInArrow(run, schema).filter(~F.col(verdict)).drop(verdict)
