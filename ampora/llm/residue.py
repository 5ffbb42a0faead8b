"""Template residue, filler and error pages.

Three grammars, all evaluated inside the scan's code-generated stage as regular expressions over whole texts, no Python and no
shuffle:

* unfilled placeholders and failed fills, one pattern per kind of delimiter; what stands in code (fenced blocks, back-quoted
  spans) and in lines that explain template syntax doesn't count;
* messages instead of content (errors, refusals, waiting, log-in, maintenance, scripts or cookies needed), by density: nearly
  all letters of a line belong to the vocabulary of messages, one of its words to the signs of a failure, a wait or a demand,
  and the text holds hardly any line as long as an article's; an article that speaks of such things doesn't count;
* filler: the same test with the words of filler text.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One pattern per kind of delimiter.
PLACEHOLDERS = (
    r"\{\{[^{}\n]{0,60}\}\}",
    r"\{%[^%\n]{0,60}%\}",
    r"\$\{[^{}\n]{0,60}\}",
    r"\{[a-z][a-z0-9]*(?:[._][a-z0-9]+)*\}",
    r"\[\[[^\[\]\n]{0,60}\]\]",
    r"<%=?[^%\n]{0,60}%>",
    r"%%[A-Za-z][\w.]*%%",
    r"#[a-z][a-z0-9]*(?:[._][a-z0-9]+)*#",
    r"__[a-z][a-z0-9]*(?:[._][a-z0-9]+)*__",
    r"_{4,}",
    r"\[(?:INSERT|YOUR|ENTER|ADD) [^\]\n]{1,60}\]",
    r"<[a-z][a-z0-9]*(?:[._][a-z0-9]+)* here>",
    r"【[^】\n]{1,60}】请填写",
    r"\[object Object\]",
    r"\b(?:undefined|NaN|null)\s+(?:[MGk]Wh?|MW)",
    r"\bXX+\s+(?:[MGk]Wh?|MW)",
)
# What marks a line that explains template syntax: its placeholders don't count while they are few for its length.
TUTORIAL = r"(?i)\b(?:placeholders?|template (?:syntax|language|engine|variables?)|tutorial|syntax|snippet|escape sequence)\b|占位符|模板语法"

# What messages say, by role, in the languages that occur: words that state a failure, a wait or a demand, ...
SIGNS = (
    r"not found|could not be|cannot be|no longer|forbidden|denied|blocked|refused|unavailable|errors?|timed out|expired|maintenance|upgrade|loading|loads|wait|verifying|checking|puzzle|scripts?|javascript|cookies|newer|snag|wrong|moved|renamed|deleted|removed|too many|log ?in|sign ?in|isn't|is not|unexpected|exited|failed|fatal|cannot|disabled|unsupported",
    r"no encontrad[oa]|no existe|caducó|caducad[oa]|denegado|bloqueado|mantenimiento|cargando|habilite|active|error|espere",
    r"não encontrad[oa]|não existe|expirou|negado|bloqueado|manutenção|carregando|habilite|ative|erro|aguarde",
    r"introuvable|n'existe plus|expiré|refusé|bloqué|maintenance|chargement|activez|autorisez|erreur|patientez",
    r"nicht gefunden|gibt es nicht|abgelaufen|gesperrt|verweigert|wartungsarbeiten|geladen|erlauben|schalten|fehler|warten",
    r"不存在|删除|移走|失效|下线|过期|受限|拒绝|拦截|违规|无法|超时|开小差|繁忙|异常|维护|升级|加载|验证|过低|打开|启用|允许|开启|登录|错误",
)
# ... the other words of such messages, ...
WORDS = (
    r"http|page|address|document|file|story|article|site|website|service|backend|server|requests?|requested|asked|reference|ref|internal|worker|response|header|upstream|rendering|reading|template|database|connect|connection|open|line|inc|index|main|db|page|firewall|filter|security|web|owner|content|country|region|offered|available|network|device|browser|application|settings|session|existed|exists?|found|located|human|moment|seconds?|minutes?|hours?|shortly|briefly|temporarily|currently|scheduled|soon|back|again|later|try|turn|switch|enable|allow|change|reload|continue|complete|needs?|run|both|please|sorry|oops|whoops|hm|something|ray|takes?|few|scripts|gateway|status|code|end|while",
    r"página|enlace|erro|acceso|cortafuegos|código|minutos|estamos|volvemos|contenido|artículo|navegador|javascript|scripts|cookies|leer|ver",
    r"página|endereço|acesso|firewall|código|minutos|site|voltamos|conteúdo|artigo|navegador|javascript|scripts|cookies|ler|ver|mais",
    r"page|adresse|accès|pare-feu|code|minutes|retour|contenu|article|navigateur|javascript|scripts|cookies|lire|voir",
    r"seite|adresse|zugriff|vorgang|minuten|zurück|inhalt|artikel|skripte|javascript|cookies|lesen|mehr|bitte",
    r"抱歉|对不起|访问|请求|查找|浏览器?|页面|文章|内容|地址|链接|发布者|暂时|查看|安全策略|防火墙|系统|编号|服务器|网络|稍后|稍候|再试|重试|分钟|小时|错误码|网站|预计|恢复|重新|人机|安全|进行|点击|图中|文字|完成|滑块|版本|正常|显示|本页|脚本|功能|刷新|数据|正在|javascript|cookies?",
)
# ... and words that say nothing by themselves.
PLAIN = (
    r"the|a|an|this|that|you|your|we|it|is|are|was|were|be|been|being|by|on|in|of|for|to|and|or|at|from|will|may|have|has|had|with|as|doing|do|no|not|now|here|us|if|so|up|out|longer",
    r"el|la|los|las|un|una|en|de|por|para|su|sus|o|y|que|ya|se",
    r"o|a|os|as|um|uma|em|de|do|da|pelo|pela|para|seu|sua|ou|e|que|não",
    r"le|la|les|l|un|une|dans|de|d|du|des|par|pour|votre|vos|ou|et|cette|ce|n|est|en|cours|plus",
    r"die|der|das|den|dem|ein|eine|in|im|um|zu|zum|sie|diese|dieser|und|oder|ist|sind|wir|es|nicht|wird|ein",
    r"您|的|或|已|被|因|该|请|后|在|将|中|了|再|以|并|：",
)
# Words of filler text.
FILLER = r"lor[eu]m|ips[a-z]{1,3}|dol[a-z]{1,4}|sit[a-z]{0,3}|amet|consec[a-z]*|adipis[a-z]*|elit|sed|dummy|placeholder|sample|filler|headline|body|text|goes|here|paragraph|replace|before|publishing|blindtext|bitte|ersetzen|texto|de|ejemplo|exemplo|sustituir|substituir|texte|provisoire|à|remplacer|此处|为|示例|文字|发布前|请|替换|asdf|qwerty|xxx|test|foo|bar"
# What only filler says.
FILLER_SIGNS = ("lorem ips", "lorum ips", "loreum ips", "dummy paragraph", "placeholder paragraph", "filler paragraph", "sample headline", "sample body", "sample paragraph", "blindtext", "texto de ejemplo", "texto de exemplo", "texte provisoire", "此处为示例文字", "asdf asdf", "xxx xxx")

# Of a message's or filler's letters, so many must be such words; of its words, so many at least.
COVERED, LEAST_LETTERS = 0.8, 6
# So many long lines beside a message make the text an article; site furniture has one or two.
ARTICLE_LINES = 4


def _tree(words: list[str]) -> str:
    """One pattern for all words, alike beginnings once, so that a place where none begins fails at its first letter."""
    plain = sorted({w for w in words if not re.search(r"[\\\[\](){}?*+.|^$]", w)})
    rest = sorted({w for w in words if w not in plain}, key=lambda w: (-len(w), w))

    def node(ends: list[str]) -> str:
        by: dict[str, list[str]] = {}
        for w in ends:
            by.setdefault(w[:1], []).append(w[1:])
        whole = "" in by
        parts = [c + node(by[c]) for c in sorted(by) if c]
        inner = parts[0] if len(parts) == 1 and not whole else f"(?:{'|'.join(parts)})" if parts else ""
        return f"{inner}?" if whole and parts else inner

    return "|".join([*rest, *([node(plain)] if plain else [])])


@lru_cache(64)
def _words(*lists: str) -> str:
    """A pattern for whole words of any of the lists; Chinese needs no borders."""
    parts = [p for x in lists for p in x.split("|")]
    han = [p for p in parts if re.search("[一-鿿]", p)]
    latin = [p for p in parts if p not in han]
    pattern = rf"(?<!\p{{IsLatin}})(?:{_tree(latin)})(?!\p{{IsLatin}})"
    return rf"{pattern}|(?=[一-鿿：])(?:{_tree(han)})" if han else pattern


def covered(line: Column, *lists: str) -> Column:
    """The part of a lower-case line's letters that stand in words of the lists; 0 for a line without letters."""
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
    rest = F.length(F.regexp_replace(F.regexp_replace(line, _words(*lists), " "), r"[^\p{L}]+", ""))
    return F.when(letters > 0, 1 - rest / letters).otherwise(0.0)


def has_placeholder(text: Column) -> Column:
    """Whether ``text`` holds an unfilled placeholder or the output of a failed one, outside code and tutorials."""
    any_of = "|".join(PLACEHOLDERS)
    # A sign that each pattern needs; plain searches for them cost a fraction of the patterns.
    signs = ("{", "[[", "<%", "%%", "__", "[INSERT", "[YOUR", "[ENTER", "[ADD", " here>", "】请填写", "[object", "#", "undefined", "NaN", "null", "XX")
    candidate = text.contains(signs[0])
    for sign in signs[1:]:
        candidate = candidate | text.contains(sign)
    # The steps below run only for texts that pass the cheap test.
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```|~~~.*?~~~", " "), r"`[^`\n]*`", " ")
    lines = F.split(bare, "\n")
    counts = lambda l: F.coalesce(F.regexp_count(l, F.lit(any_of)), F.lit(0)) > F.when(l.rlike(TUTORIAL), F.length(l) / 80.0).otherwise(F.lit(0.0))
    return F.when(candidate, F.exists(lines, counts)).otherwise(F.lit(False))


def _says_filler(low: Column) -> Column:
    said = low.contains(FILLER_SIGNS[0])
    for sign in FILLER_SIGNS[1:]:
        said = said | low.contains(sign)
    return said


def _is_filler(line: Column) -> Column:
    return _says_filler(line) & (covered(line, FILLER) >= COVERED)


def _is_message(line: Column) -> Column:
    """Whether a lower-case line states a failure, a wait or a demand and hardly anything else."""
    signs = _words(*SIGNS)
    # A menu's or a button's few words aren't a message, unless they say that one has to wait.
    enough = (F.size(F.regexp_extract_all(line, F.lit(_words(*SIGNS, *WORDS)), 0)) >= 3) | line.rlike(r"^\W*(?:loading|cargando|carregando|chargement|wird geladen|(?:数据)?加载中)")
    hex_ids = F.regexp_replace(line, r"(?<!\p{IsLatin})(?=[0-9a-f]*\d)[0-9a-f]{4,}(?!\p{IsLatin})", " ")
    return line.rlike(signs) & enough & (covered(hex_ids, *SIGNS, *WORDS, *PLAIN) >= COVERED)


def is_message(text: Column) -> Column:
    """Whether ``text`` is a message or filler with nothing of an article beside it.

    A line is one by density: nearly all its letters belong to words of messages, one of them a sign of failure. An article
    that speaks of such things says who and where in the same line. The text counts while fewer than ``ARTICLE_LINES`` of its lines
    are as long as an article's.
    """
    is_long = lambda line: (F.length(line) >= 120) | ((F.length(line) >= 45) & (F.length(F.regexp_replace(line, r"[^\p{IsHan}]+", "")) >= 45))
    lines = lambda: F.split(text, r"\n")
    long_lines = lambda keep: F.size(F.filter(lines(), lambda line: is_long(line) & keep(line)))
    # Nearly all texts are told by their long lines; filler's own are left out of them where there is filler at all.
    message = (long_lines(lambda line: F.lit(True)) < ARTICLE_LINES) & F.exists(lines(), lambda line: ~is_long(line) & _is_message(F.lower(line)))
    filler = _says_filler(F.lower(text)) & (long_lines(lambda line: ~_says_filler(F.lower(line))) < ARTICLE_LINES)
    # Filler makes the other long lines fewer, so a message beside it is looked for again.
    return message | (filler & F.exists(lines(), lambda line: _is_filler(F.lower(line)) | (~is_long(line) & _is_message(F.lower(line)))))


def residue(documents: DataFrame) -> DataFrame:
    """``documents`` with column ``residue``: ``placeholder``, ``message`` or null.

    Null texts are no case. Needs column text; others are kept.
    """
    text = F.col("text")
    return documents.withColumn("residue", F.when(has_placeholder(text), "placeholder").when(is_message(text), "message"))


def is_residue(text: Column) -> Column:
    """Whether ``text`` holds no real content or an unfilled template, whichever; false for null."""
    return F.coalesce(has_placeholder(text) | is_message(text), F.lit(False))


def found(documents: DataFrame) -> DataFrame:
    """``doc_id`` of every document that holds no real content or an unfilled template."""
    return documents.select("doc_id", "text").where(is_residue(F.col("text"))).select("doc_id")
