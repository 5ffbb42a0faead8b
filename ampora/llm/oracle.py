"""SQL forms of those queries of the text problems that SQL can express over whole tables.

The forms share nothing with the operators: p6's messages are whole sentences here, where the operator weighs words, and the
placeholders and stand-ins are written out again.
"""

from __future__ import annotations

STAND_INS = ("", "tbd", "tba", "unknown", "未知", "-", "?", "n/a", "na", "none", "null", "s/d", "k.a.", "—", "–", "--", "待定", "未披露", "to be confirmed", "not disclosed", "nan", "undefined", "n.d.", "...", "??", "不详", "暂无")
_STAND_INS = ", ".join("'" + s.replace("'", "''") + "'" for s in STAND_INS)

P5_FOUND = f"""
WITH many AS (SELECT canonical_key FROM projects WHERE canonical_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
r AS (
  SELECT p.canonical_key, p.row_id, p.fields_json, p.updated_at, coalesce(s.trust_level, 0) AS trust,
         coalesce(from_json(p.conflicts_json, '[{{"field":"VARCHAR"}}]'), []) AS conflicts,
         coalesce(json_keys(p.evidence_json), []) AS evidence
  FROM projects p JOIN many USING (canonical_key) LEFT JOIN sources s USING (source_id)),
f AS (SELECT *, unnest(json_keys(fields_json)) AS field FROM r),
v AS (SELECT *, json_extract_string(fields_json, '$."' || field || '"') AS value FROM f),
ranked AS (
  SELECT canonical_key, field, row_id, row_number() OVER (PARTITION BY canonical_key, field ORDER BY
    CASE WHEN list_contains(list_transform(conflicts, lambda c: c.field), field) THEN 1 ELSE 0 END,
    CASE WHEN list_contains(evidence, field) THEN 0 ELSE 1 END, trust DESC, updated_at DESC NULLS LAST, row_id) AS n
  FROM v WHERE value IS NOT NULL AND lower(trim(regexp_replace(value, '[\\s 　]+', ' ', 'g'))) NOT IN ({_STAND_INS}))
SELECT canonical_key, field, row_id FROM ranked WHERE n = 1
"""

P7_FOUND = r"""
WITH d AS (SELECT doc_id, coalesce(source_id, '') AS s, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, s, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS line_no FROM d),
k AS (SELECT doc_id, s, line_no, regexp_replace(replace(lower(line), 'ß', 'ss'), '[^\p{L}]', '', 'g') AS key FROM l),
c AS (SELECT s, key, count(DISTINCT doc_id) AS n FROM k WHERE key <> '' GROUP BY ALL),
t AS (SELECT s, count(*) AS total FROM d GROUP BY ALL)
SELECT doc_id, CAST(line_no AS INT) AS line_no FROM k JOIN c USING (s, key) JOIN t USING (s) WHERE n >= 3 AND n >= 0.05 * total
"""


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


# Sentences of filler text.
FILLER = (
    r"lor[eu]m ips[a-z]+ dol[a-z]+[^.\n]*",
    r"sample (?:headline|body text) goes here",
    r"(?:dummy|placeholder|sample|filler) paragraph, replace before publishing",
    r"blindtext(?: blindtext)*(?:, bitte ersetzen)?",
    r"texto de ejemplo",
    r"sustituir",
    r"texto de exemplo",
    r"substituir",
    r"texte provisoire(?: à remplacer)?",
    r"此处为示例文字(?:，发布前请替换)?",
    r"asdf(?: asdf)*(?: test)*(?: 123)?(?: test)*",
    r"xxx(?: xxx)+",
)

_N = r"[0-9a-f]{1,16}"
# Whole lines that are messages instead of content, by what they say. {n} stands for a number or a reference.
MESSAGES = {
    "not found": (
        r"(?:error )?{n} – the (?:page|address|document|file) you (?:requested|asked for) (?:was not found|could not be (?:found|located)|no longer exists) on this server",
        r"(?:página no encontrada|error {n})\. el enlace {n} (?:caducó|ya no existe)",
        r"(?:página não encontrada|erro {n})\. o endereço {n} (?:expirou|não existe mais)",
        r"(?:page introuvable|erreur {n})\. l'adresse {n} (?:a expiré|n'existe plus)",
        r"(?:seite nicht gefunden|fehler {n})\. die adresse {n} (?:ist abgelaufen|gibt es nicht mehr)",
        r"(?:抱歉，|对不起，)?您(?:访问|请求|查找|浏览)的(?:页面|文章|内容|地址|链接)不存在或已(?:被删除|被移走|失效|下线|过期)",
        r"(?:hm|oops|sorry|whoops)[.!] (?:we hit a snag|something went wrong)\. the (?:story|page|article) may have been (?:moved|renamed|deleted|removed)",
        r"该内容(?:因违规无法查看|已被发布者删除|暂时无法查看|已被删除|不存在)",
    ),
    "refused": (
        r"(?:{n} forbidden|forbidden|access denied)\. your request was (?:blocked|refused) by the (?:web firewall|security filter|site owner) \(ref {n}\)",
        r"acceso (?:denegado|bloqueado) por el cortafuegos, código {n}",
        r"acesso (?:negado|bloqueado)(?: pelo firewall)?, código {n}",
        r"accès (?:refusé|bloqué) par le pare-feu, code {n}",
        r"zugriff (?:gesperrt|verweigert), vorgang {n}",
        r"访问(?:受限|被拒绝)：您的请求被(?:安全策略|防火墙|系统)拦截，编号 ?{n}",
        r"this content (?:isn't|is not) (?:offered|available) in your (?:country|region)",
        r"too many requests from your (?:address|network|device), try again in {n} (?:minutes|seconds|hours)",
    ),
    "server": (
        r"(?:error|http) {n}: the (?:backend|site|service) is (?:briefly|temporarily|currently) unavailable\. request no\. {n}",
        r"{n} service unavailable: the (?:backend|site|service) is (?:briefly|temporarily|currently) unavailable\. request no\. {n}",
        r"internal server error: (?:worker exited|unexpected end of response|upstream timed out) while (?:reading the response header|rendering the page)",
        r"fatal error: cannot (?:open template|connect to database) in [a-z]+\.inc on line {n}",
        r"(?:服务器开小差了|系统繁忙|网络异常)，请(?:稍后|{n} ?分钟后)(?:再试|重试)（错误码 ?{n}）",
    ),
    "maintenance": (
        r"we are doing (?:an upgrade|scheduled maintenance|maintenance) and will be back (?:shortly|in {n} minutes|soon)",
        r"estamos en mantenimiento; volvemos en {n} minutos",
        r"site em manutenção; voltamos em {n} minutos",
        r"maintenance en cours, retour dans {n} minutes",
        r"wartungsarbeiten, in {n} minuten sind wir zurück",
        r"(?:网站|系统)(?:维护|升级)中，预计 ?{n} ?(?:小时|分钟)后恢复",
    ),
    "log-in": (
        r"your session has (?:timed out|expired)\. (?:log in|sign in again) to continue",
        r"登录已(?:超时|失效|过期)，请重新登录",
    ),
    "waiting": (
        r"please wait while the (?:article|page|content) loads",
        r"(?:complete the puzzle to go on|checking that you are human|one moment, verifying your connection)(?:…)? this takes a few seconds\. ray {n}",
        r"loading(?: (?:content|article|page))?(?:, please wait)?",
        r"cargando(?: el (?:contenido|artículo), espere)?",
        r"carregando(?: o (?:conteúdo|artigo), aguarde)?",
        r"chargement(?: (?:de l'article|du contenu), patientez)?",
        r"(?:inhalt |artikel )?wird geladen(?:, bitte warten)?",
        r"(?:数据)?加载中(?:，请稍候)?",
        r"正在进行(?:人机|安全)验证，请(?:点击图中文字|完成滑块)",
    ),
    "scripts": (
        r"please (?:switch on|turn on|enable|allow) (?:javascript|scripts|cookies) in your browser to (?:read|see|view) this (?:page|site|article)",
        r"this (?:page|site|application) needs (?:scripts to run|cookies and javascript|a newer browser|javascript|cookies)\. (?:change your settings|enable both) and reload",
        r"(?:active|habilite) (?:javascript|los scripts|las cookies) en su navegador para (?:leer|ver) el contenido",
        r"(?:ative|habilite) (?:o javascript|os scripts|os cookies) do navegador para (?:ler|ver) o conteúdo",
        r"(?:activez|autorisez) (?:javascript|les scripts|les cookies) dans votre navigateur pour (?:lire|voir) cette page",
        r"bitte (?:erlauben sie skripte|schalten sie javascript ein|schalten sie skripte ein|erlauben sie javascript|erlauben sie cookies), um diese seite zu lesen",
        r"您的浏览器版本过低，无法(?:正常显示|打开|浏览)本页内容",
        r"请(?:打开|启用|允许|开启)浏览器(?:javascript|脚本|cookies?)(?:功能)?后(?:刷新|重新访问|重新打开)本页",
    ),
}

# So many long lines beside a message make the text an article.
ARTICLE_LINES = 4

_END = r"[\s.。…!！»]*"


def message_line() -> str:
    """A regular expression for a whole line of lower-case text that is a message."""
    all_messages = "|".join(m for group in MESSAGES.values() for m in group).replace("{n}", _N)
    return rf"(?:{all_messages}){_END}"


def filler_line() -> str:
    one = "|".join(FILLER)
    return rf"(?:(?:{one})[\s.。!]*)+{_END}"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_LINE = rf"(?m)^[ \t]*(?:{message_line()[:-len(_END)]}|{filler_line()[:-len(_END)]}){_END}$"
P6_FOUND = rf"""
WITH d AS (SELECT doc_id, lower(text) AS low,
    string_split(regexp_replace(regexp_replace(text, '(?s)```.*?```|~~~.*?~~~', ' ', 'g'), '`[^`\n]*`', ' ', 'g'), chr(10)) AS bare FROM documents WHERE text IS NOT NULL)
SELECT doc_id FROM d
WHERE len(list_filter(bare, lambda l: len(regexp_extract_all(l, {_quoted("|".join(PLACEHOLDERS))})) > CASE WHEN regexp_matches(l, {_quoted(TUTORIAL)}) THEN length(l) / 80.0 ELSE 0 END)) > 0
   OR (regexp_matches(low, {_quoted(_LINE)})
       AND len(list_filter(string_split(low, chr(10)), lambda l: (length(l) >= 120 OR length(regexp_replace(l, '[^\p{{Han}}]+', '', 'g')) >= 45) AND NOT regexp_full_match(l, {_quoted(filler_line())}))) < {ARTICLE_LINES})
"""


def oracle_sql() -> dict[str, str]:
    return {"p5_found": P5_FOUND, "p6_found": P6_FOUND, "p7_found": P7_FOUND}
