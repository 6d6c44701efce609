"""Template residue, filler, error pages and script notices in documents.

Lines are cut into sentences, and those that hold a word of notices at all are
mined into message templates with a prefix tree of fixed depth: length, then
the first three words. In a template the words of the lexicon below stand
fixed, numbers, code and quotations are masked, and other words become
variable where they differ. Each template is classified once and its verdict
goes back to all sentences it stands for. Unresolved slots are looked for
separately, inside ordinary lines. A document's verdict then weighs its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The lexicon of notices, by what a word does in them.
#: What a reader asked for, or what serves it.
THINGS = """
page pages site website webpage web url uri link address path document documents file files resource resources repository repo project content contents item article view viewer
dashboard image service services server servers host hostname domain gateway proxy upstream backend database network connection request requests session login account access firewall cloudflare
application app system client response dns ip location permission permissions authorization authentication rights area section entity user users members subscribers staff side process operation
method media type thing things ray requested
página pagina página archivo arquivo sitio recurso servicio serviço servidor sesión sessão acceso acesso usuario conexión conexão pedido solicitud sistema enlace sua seite datei dienst server sitzung zugriff verbindung
anfrage adresse inhalt ressource accès serveur fichier connexion site lien requête demande contenu navegador navigateur
""".split()
#: What went wrong.
FAILS = """
forbidden unauthorized unauthorised denied refused rejected blocked banned restricted limited prohibited unavailable unreachable inaccessible missing gone expired ended timeout timedout invalid lost
closed broken busy down offline overloaded maintenance moved deleted removed disabled suspended crashed failed fails failing wrong bad conflict unexpected unknown fatal internal found404 nonexistent
toolong toomany reset interrupted unsupported unacceptable required exceeded unimplemented unprocessable notfound dropped aborted malfunctioned exhausted stopped corrupted lack lacking insufficient
no_longer serverfehler dead unresponsive construction parked unable
denegado denegada negado interno interna expirado expirada caducado caducada terminado terminou expirou prohibido proibido incorrecto incorrecta interdit refusé indisponible indisponível introuvable interne expiré terminée
terminé verweigert abgelaufen verboten interner unerreichbar gesperrt fehlgeschlagen
""".split()
NOTS = "not cannot cant can't couldn't couldnt could_not didn't doesn't isn't wasn't won't don't unable never neither no nor without nothing nicht kein keine non pas aucun nunca não ningún ninguna ne n'a".split()
DOES = """
found find shown show displayed display loaded load opened open reached reach located locate accessed retrieved retrieve fetched fetch resolved resolve processed process completed complete exist exists existed
existe existiert respond responded responding answer answered available accessible reachable work worked working continue connect connected establish established serve served serving render rendering rendered implemented
allowed permitted supported acceptable process handled handle fulfill fulfilled view viewed perform loading opening processing handling
encontrada encontrado encontró encontrou disponible disponível gefunden erreichbar verfügbar trouvée trouvé geladen cargar carregar charger angezeigt
""".split()
ERRORS = "error errors failure exception fault problem trouble http https status code oops whoops uh uhoh issue erro fehler erreur interruption outage snag hiccup".split()
#: What a reader is told to do.
ASKS = """
try again retry reload refresh back later soon shortly wait hold moment minute minutes seconds moments sign log signing logging contact check come return administrator admin webmaster owner support
slow tarde nuevo novo plus tard später erneut réessayer réessayez inténtelo intente tente versuchen bitte keeps happening persists continues write verify confirm prove human robot captcha complete
""".split()
SCRIPTS = "javascript js script scripts scripting ecmascript javascripts noscript client-side".split()
SWITCHES = """
enable enabled enables activate activated allow allowed permit permitted turn turned switch switched on off unblock unblocked required requires require needed needs need necessary must should disabled disable blocked missing
supported support inactive deactivated unavailable without works work runs run loads available active only has have
activer activez active activa ative autoriser autorisez autorise habilite habilita habilitar permita permitir permite activar ativar aktivieren aktiviere erlauben erlaube einschalten schalten ein benötigt erforderlich nécessaire
necesario necesita precisa requer requis désactivé deactivé desactivado desativado deaktiviert
""".split()
#: Words that notices are made of besides; they count for nothing.
PLAIN = """
kindly wiki forum docs help readme graph graphs the a an this that these those it its it's that's there here to of in on at by from for with and or as is are was were be been being has have had do does did can could will would may might must shall should i
you your yours we our ours us we're you're they them me my please sorry hmm hey hello welcome dear just now right currently temporarily momentarily presently still yet ever any more anymore some something anything everything all
too very so also then than before after while during into within over under out up off again first next new old other another one two few many much long went go goes going gone getting get got seems seem looks look like appears appear has
asked asking requested looking trying tried visit visiting visited want wanted use used using see seeing know knew took take takes taken make made due because reason cause occurred occur happened happen encountered
encounter experienced generated returned reported server's browser browsers cookies cookie settings feature features full version properly correctly fully normally interactive device computer region country ip
continuing proceed proceeding progress our's side maintained scheduled planned soon short time times moment maybe perhaps might've may've either believe think mistake help assistance details information more
too exists anywhere elsewhere somewhere nowhere where what whatever who how why which mistyped typed
el la los las un una unos de del en y o que por para con su sus se no está esta este estamos momento favor antes seguir continuar ver abrir cargar usar ahora actualmente grafo gráfico sitio
le la les un une des du de dans et ou que qui pour par avec votre vos notre est sont a été ce cette momentanément actuellement temporairement veuillez merci d'activer il faut afin continuer afficher voir graphe navigateur votre vous
der die das den dem ein eine einen und oder ist sind wird wurde wurden in im auf an zu zum um damit für mit von ihre ihr ihrem ihren sie wir uns derzeit zurzeit gerade momentan vorübergehend leider fortzufahren anzuzeigen laden browser konnte
kann diese dieser dieses graphen
o os as um uma do da dos das no na nos nas e ou que por para com seu sua não está este esta momento abrir ver continuar agora carregar pode foi
""".split()
#: Words by which a sentence tells about something instead of giving notice; they count double.
TELLS = "when because once until since whose whenever although whereas unless returns returned marks fixed fix fixes caused causes handles handled tests tested covered shows showed receives received answers answered added adds".split()
#: Words of a story or a condition, which no error message has.
STORY = frozenset("i he she they before after if as than its whether since although".split())
# The same in scripts without spaces, longest first in matching.
CJK = {
    "thing": "页面 网页 网站 页 站点 文件 资源 服务器 服务 访问 会话 请求 连接 网关 地址 链接 内容 您的 ページ サイト ファイル リソース サーバー サービス アクセス セッション リクエスト 接続 権限 内部 权限 本页".split(),
    "fail": "不存在 找不到 未找到 无法 被拒绝 拒绝 已过期 过期 结束 失效 不可用 超时 禁止 错误 失败 维护中 维护 出错 断开 繁忙 已失效 見つかりません 存在しません 拒否されました エラーが発生しました エラー 切れました 終了しました 期限切れ 利用できません 停止中 タイムアウト 禁止されています ありません 失敗しました できません".split(),
    "script": "脚本 スクリプト".split(),
    "switch": "启用 打开 开启 允许 啟用 開啟 禁用 阻止 关闭 需要 許可 有効化 有効 オン 無効 ブロック 必要".split(),
    "plain": "请 請 先 后再 后 再 的 了 在 已 被 暂时 当前 您 浏览器 加载 图形 继续 查看 使用 以 内部 状态 稍后 重试 を に が の は で も て から この その 現在 一時的に ご お 表示 する して ください 読み込む グラフ 続行 閲覧 には ために です ます ました されて いる います ブラウザ ブラウザー".split(),
}

NAV = "home docs blog explore topics help products pricing team contact menu search about features support login logout register imprint privacy terms sitemap wiki forum status news careers faq".split()
_NAV = "|".join([*(w.capitalize() for w in NAV), "Sign in", "Sign up", "Log in", "Skip to (?:main )?content"])
#: What surrounds a page and is content of neither kind: navigation, ids, server signatures.
CHROME = re.compile(
    rf"(?<![\w'])(?:{_NAV})(?:(?:\s*[|/·•»>-]\s*|\s+)(?:{_NAV}))+(?![\w'])|^\s*(?:{_NAV})\s*$|(?:(?<=\s\s)|^)(?:{_NAV})(?=\s\s|$)|(?i:skip to (?:main )?content)|"
    r"(?i:\b(?:request|ray|incident|reference|trace|error|event|ticket)(?: id)?[ :#]+(?=\w*\d)[\w-]{5,}(?: has been (?:logged|reported|recorded))?)|(?i:\b(?:request|ray|incident|reference|trace) id:? [\w-]{4,})|"
    r"(?i:\b(?:httpd|nginx|apache|caddy|iis|openresty|varnish)[/ ][\d.]+)|(?i:\b(?:edge|proxy|cache|cdn) (?:node )?\w*\d+)|"
    r"(?i:\b(?:back|return|go) to (?:the |our )?(?:start|home|main|front|previous) ?page)|(?i:\b(?:contact|write to|tell) (?:the |our )?(?:site owner|support|administrator|webmaster))|(?i:\bif (?:this|the problem|it) (?:keeps happening|persists|continues))|[©(]c?\)? ?\d{4}[\w ,.]{0,40}",
)
_NAV_AT_END = re.compile(rf"(?:(?<=\s)|^)(?:{_NAV})$|^(?:{_NAV})(?=\s)")

# The words of the customary pseudo-Latin filler.
LOREM = set(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat "
    "duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum".split()
)
FILLER_WORDS = set(
    "text texts textes texte texto sample samples dummy placeholder placeholders filler blindtext fülltext platzhaltertext platzhalter beispieltext lorem ipsum asdf qwerty foo bar baz qux test testing bla blah blub "
    "more fill page the to here goes some example content this is just a an and for your words paragraph another yet still only write insert add replace xxx hier steht texto de relleno ejemplo".split()
)
FILLER_CORE = set("text texts texte texto sample dummy placeholder filler blindtext fülltext platzhaltertext platzhalter beispieltext asdf qwerty bla blah blub xxx lorem ipsum foo bar baz relleno".split())
#: Words that no sentence of these languages lacks for long; filler has none.
FUNCTION = set(
    "the of and is to that for with was are we you this it as on by from be not its which when if has have can der die das und ist nicht ein eine mit von wird le la les des une dans pour sur est pas el los las una con por para uma com não".split()
)

# Notations of template fields.
_SLOT_NAME = r"(?:cookie(?:cutter)?\.|project\.|config\.|site\.|page\.|user\.)?(?:your[_ ])?(?:project|repo|repository|package|module|app|author|owner|maintainer|version|title|summary|description|name|user|username|email|date|year|slug|license|organi[sz]ation|company|url|link|component|feature|product|team|branch|release)(?:[_ -]?(?:name|slug|id|url|title|version|email|description|date|here))*"
SLOTS = re.compile(
    r"(?<!\$)\{\{-?\s*[\w.|() '\"-]{1,60}\s*-?\}\}|<%[=-]?\s*[\w.\[\]() '\"-]{1,60}\s*-?%>|\{%-?\s*\w+(?:\s+[\w.'\" -]{1,40})?\s*-?%\}|\$\{[A-Za-z_][\w.]{0,40}\}|#\{[A-Za-z_][\w.]{0,40}\}|%%[A-Za-z_]\w{0,40}%%|@@[A-Za-z_]\w{0,40}@@|"
    rf"(?<![\w$])\$[A-Za-z_]\w{{1,40}}\$(?![\w$])|(?<!\w)__{_SLOT_NAME}__(?!\w)|«\s*{_SLOT_NAME}\s*»|"
    r"\[(?:your|insert|enter|add|fill in|replace|put)\b[^\]\n]{0,50}\](?!\()|\[[^\]\n]{1,40} (?:goes )?here\](?!\()|<(?:your|insert|enter|add|replace)[ _-][^<>\n]{1,50}>|<[^<>/\n]{1,50} (?:goes )?here>|<YOUR_\w+>|"
    r"\b(?:REPLACE|CHANGE|FILL)_?(?:ME|THIS)(?:_\w+)?\b|\{(?:YOUR|INSERT)[_ ]\w+\}",
    re.I,
)
FORM = re.compile(
    r"(?:[\w *#-]{2,40}:\s*)?(?:<(?:short |long |brief |please |bitte |a |the )*[\w ]{2,40}>|\((?:replace|describe|insert|fill in|add|write|delete)[\w ]{2,40}\)|<!--.{0,200}?-->|\[ ?\] [\w ]{1,40}|- \[ ?\] [\w /]{1,60}|_{3,}|\.{4,})|"
    r"(?:to ?do|tbd|fixme|tba|wip|xxx)(?:[:. -]+(?:write|describe|add|fill|document|explain|insert|complete|list|update)[\w ,]{0,60})?|(?:coming soon|to be (?:written|done|completed|decided|added))|"
    r"(?:your |the |some )?[\w ]{2,30} goes here|(?:write|put|type|insert|enter|add) (?:something|some text|your text|text here|a few words)\b[\w ]{0,30}|(?:describe|explain|insert|add|write|replace|fill in) (?:here|the|your|this|a|an)\b[\w ]{0,50}|<(?:bitte|veuillez|por favor)[\w äöüßéèñç]{2,40}>",
    re.I,
)
LABEL = re.compile(r"(?:\*\*)?[\w ]{2,40}(?:\*\*)?:?(?:\*\*)?|[-*] \[ ?\] [\w ]{1,40}|#+ .{1,60}")

#: Words by which a line speaks of slots instead of holding one.
SPEAKS = re.compile(
    r"\b(?:templates?|templating|placeholders?|variables?|interpolat\w+|substitut\w+|replaced|replaces|replacing|expanded|expansion|syntax|mustaches?|jinja2?|vue|angular|handlebars|liquid|erb|django|escap(?:e|es|ed|ing)|"
    r"braces|brackets|literal(?:ly)?|notation|unresolved|unfilled|unrendered|evaluates?|evaluated|such as|e\.g\.|for example|stands for|written as|looks like|delimiters?|binding|bindings|shell|environment|regex|pattern|patterns)\b|"
    r"\b(?:Platzhalter|Vorlagen?|Variablen?|gabarits?|modèles?|plantillas?|marcadores?)\b|模板|占位符|变量|テンプレート|プレースホルダー|変数",
    re.I,
)
#: A line of code or of a command with variables in it.
CODE_LINE = re.compile(
    r"^\s*(?:\$ |> |export |set |cd |echo |run:|env:|docker |git |make |npm |npx |yarn |pip |cargo |go |curl |wget |kubectl |helm |terraform |sudo |mkdir |cp |mv |rm |source |python\d? |node |bash |sh )|"
    r"[;{]\s*$|\w\s*=\s*[\"'$\w]|=>|\w\(.*\)\s*;?\s*$|^\s*[\w.-]+:\s*[\"']?\$\{|&&|\|\||^\s*(?:if|for|while|return|const|let|var|def|fn|func)\b.*[:;{)]\s*$|\$\{\w+\}/|/\$\{"
)

_TAGS = re.compile(r"</?(?:html|head|body|title|h[1-6]|p|hr|br|div|span|center|noscript|b|i|em|strong|main|section|pre|a|ul|li|footer|header|nav)(?:\s[^<>]*)?/?>|<!doctype[^>]*>", re.I)
_INLINE = re.compile(r"``.+?``|`[^`\n]*`")
_QUOTED = re.compile(r"\"[^\"\n]{2,160}\"|“[^”\n]{2,160}”|„[^“”\n]{2,160}[“”]|«[^»\n]{2,160}»|「[^」\n]{2,160}」|『[^』\n]{2,160}』|(?<!\w)'[^'\n]{2,160}'(?!\w)")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", re.U)
_CJK = re.compile(r"[぀-ヿ一-鿿]")
_SENTENCE = re.compile(r"\s(?:(?<=[.!?]\s)\s*|(?<=\n)\s*|\s+|\|\s+|(?<=\S\s)[-–—]\s(?=\S))")
_CJK_SENTENCE = re.compile(r"(?<=[。！？])\s*")
_CLAUSE = re.compile(r"[;:] (?=\S)")
#: Customary phrases that count as one word.
_PHRASES = [
    (r"(?<![\w/])/[\w.-]+(?:/[\w.-]*)*|\bhttps?://\S+", " url "), (r"\btoo (?:long|slow)\b", "toolong"), (r"\btoo many\b", "toomany"), (r"\btim(?:ed|e|ing)[ -]?out\b", "timeout"), (r"\bno longer\b", "no_longer"),
    (r"\b(?:(?:file|page) )?not found\b", "notfound"), (r"\bout of (?:service|order)\b", "unavailable"), (r"\bunder (?:construction|maintenance)\b", "construction"), (r"\bdoes(?:n't| not) exist\b", "nonexistent"), (r"\bbranch view\b", "view"), (r"’", "'"),
]
_PHRASE = re.compile("|".join(f"(?P<p{i}>{a})" for i, (a, _) in enumerate(_PHRASES)))
_CJK_OF = {w: k for k, ws in CJK.items() for w in ws}
_TOKEN = re.compile("|".join(sorted(map(re.escape, _CJK_OF), key=len, reverse=True)) + r"|[぀-ヿ一-鿿]|[\ue000\ue001]|[^\W\d぀-ヿ一-鿿]+(?:['-][^\W\d]+)*|\d[\w.,]*", re.U)

_THINGS, _FAILS, _NOTS, _DOES, _ERRORS, _ASKS, _SCRIPTS, _SWITCHES, _PLAIN, _TELLS = map(frozenset, (THINGS, FAILS, NOTS, DOES, ERRORS, ASKS, SCRIPTS, SWITCHES, PLAIN, TELLS))
LEXICON = _THINGS | _FAILS | _NOTS | _DOES | _ERRORS | _ASKS | _SCRIPTS | _SWITCHES | _PLAIN | _TELLS | STORY | frozenset(_CJK_OF)
_LOOSE = STORY - _PLAIN
#: Words of which a sentence needs one to be a notice; negations count beside the second group.
_SAYS = _FAILS | _ERRORS | _SCRIPTS | frozenset("long slow many timed human captcha robot".split())
_OF_NOTS = _THINGS | _DOES | _SCRIPTS | frozenset("we you found exist longer".split())
_FILLS = FILLER_CORE | LOREM
#: How a form's line begins.
_FORM_START = re.compile(r"(?:[\w *#-]{2,40}:\s+(?=[<(\[_]))?[\W_]*(?:(?<=[<(\[_])|(?<=\.{4})|(?i:to ?do|tbd|fixme|tba|wip|xxx|coming|to be|write|put|type|insert|enter|add|describe|explain|replace|fill)\b|(?i:your|the|some|text)\b(?=.{0,40}\bhere\b))")
_STATUS = re.compile(r"\b[45]\d\d\b")
#: Words of navigation and ids, beside which there may be a title in the same line.
_NAVS = frozenset(NAV) | frozenset("incident ray httpd nginx skip main".split())
_AROUND = _NAVS | frozenset("request ray incident reference trace error event ticket apache caddy iis openresty varnish edge proxy cache cdn back return go contact write tell if sign log c".split())
_ASK_LINE = _ASKS | _PLAIN | _THINGS
_COVERED = LEXICON | frozenset(NAV) | frozenset("request id ray incident ticket trace logged been reported httpd nginx edge node explore topics skip main keeps happening write sign register menu branch".split())
_CJK_CORE = re.compile("|".join(sorted(map(re.escape, CJK["fail"] + CJK["switch"] + CJK["script"]), key=len, reverse=True)))
_SPACED = str.maketrans({c: " " for c in "!\"#$%&()*+,./:;<=>?@[\\]^`{|}~–—•·“”„«»…。！？、，；："})


def n_words(text: str) -> int:
    """Words of a text; of scripts without spaces every third character counts as one."""
    cjk = len(_CJK.findall(text)) if not text.isascii() else 0
    return len(_WORD.findall(_CJK.sub(" ", text) if cjk else text)) + (cjk + 2) // 3


def is_filler(words: list[str]) -> bool:
    """Whether a line's words are filler: placeholder phrases, words over and over, or pseudo-Latin."""
    low = [w.lower() for w in words]
    n, kinds = len(low), set(low)
    if not n:
        return False
    core = kinds & FILLER_CORE
    if core and len(kinds - FILLER_WORDS) <= 0.1 * n and (n >= 3 or kinds <= FILLER_CORE and n >= 2 or kinds <= {"platzhaltertext", "blindtext", "fülltext"}):
        return True
    if n >= 8 and len(kinds) <= 4 and len(kinds) <= n // 3 or n >= 4 and kinds <= {"test", "testing", "blah", "bla"}:
        return True
    if n >= 3 and all(re.fullmatch(r"(\w)\1{1,6}", w) for w in kinds):
        return True
    latin = [w for w in low if w in LOREM]
    return n >= 4 and len(set(latin)) >= 2 and len(latin) >= 0.08 * n and sum(w in FUNCTION for w in low) <= 0.05 * n


def masked(sentence: str) -> list[str]:
    """Tokens of a sentence, lower case: statuses and other numbers masked, customary phrases as one word."""
    sentence = _PHRASE.sub(lambda m: _PHRASES[int(m.lastgroup[1:])][1], sentence.lower())
    return [("<status>" if re.fullmatch(r"[45]\d\d\W*", t) else "<n>") if t[0].isdigit() else {"\ue000": "<code>", "\ue001": "<quoted>"}.get(t, t) for t in _TOKEN.findall(sentence)]


def notice(tokens: list[str]) -> str:
    """'script', 'error', 'ask', 'chrome' or '' for the tokens of a template; '<*>' is any word.

    A notice consists of the lexicon's words nearly throughout: one in five may
    be another, none in the shortest. A script notice names scripts and what is
    to be done or wrong with them; an error names a status, or a thing and what
    is wrong with it, or hardly more than what is wrong.
    """
    cjk = [t for t in tokens if t in _CJK_OF or _CJK.match(t)]
    if cjk:
        kinds = {_CJK_OF[t] for t in cjk if t in _CJK_OF}
        loose = sum(t not in _CJK_OF for t in cjk) + sum(t not in LEXICON and t[0] != "<" for t in tokens if t not in cjk)
        if loose > 0.2 * len(tokens):
            return ""
        if ("script" in kinds or any(t in _SCRIPTS for t in tokens)) and kinds & {"switch", "fail"}:
            return "script"
        return "error" if "fail" in kinds and ("thing" in kinds or len(tokens) <= 3) else ""
    n = len(tokens)
    status = "<status>" in tokens
    words = [t for t in tokens if t[0] != "<" or t == "<*>"]
    loose = sum(t not in LEXICON or t in _LOOSE for t in words) + 2 * sum(t in _TELLS and i > 0 for i, t in enumerate(tokens)) + sum(t in ("<code>", "<quoted>") for t in tokens)
    if loose > (0 if n <= 4 else max(1, 0.2 * n)) or tokens[:2] == ["do", "not"] or tokens and tokens[-1] == "<n>" and n > 3:
        return ""
    has = set(words)
    if has & _SCRIPTS:
        return "script" if has & _SWITCHES or has & _NOTS else ""
    if has & STORY:
        return ""
    fail, no, thing, does, error = has & _FAILS, has & _NOTS, has & _THINGS, has & _DOES, has & _ERRORS
    if status and (fail or no or error or n <= 2) or "error" in has and "<n>" in tokens and n <= 2:
        return "error"
    if thing and (fail or no and (does or len(has) <= 8) or error):
        return "error"
    if error and (fail or has & {"that", "that's", "went", "occurred"} or has <= _ERRORS | _FAILS | _PLAIN and n <= 3 and (fail or len(has & _ERRORS) > 1)):
        return "error"
    if "wrong" in has or "we" in has and fail or no and does and has & {"that", "hmm", "we", "this", "it", "sorry", "oops"}:
        return "error"
    if fail and has & _ASKS and not loose or fail and n <= 3 and not has - _FAILS - _PLAIN - _THINGS - _ERRORS:
        return "error"
    if "you" in has and (fail or no) and (has & _THINGS or "human" in has):
        return "error"
    if has & {"human", "robot", "captcha"} and has & {"verify", "confirm", "prove", "complete", "are"}:
        return "error"
    return "ask" if has and has <= _ASKS | _PLAIN | _THINGS and has & _ASKS and n <= 10 else ""


def classify(tokens: list[str], sentence: str) -> tuple[str, int, int]:
    """Verdict on a template: (class, bad words, other words). ``sentence`` is one that founded it, for the signs of forms.

    Classes: 'error', 'script', 'form', 'chrome', 'label', 'content'.
    """
    n = max(1, n_words(sentence))
    s = sentence.strip()
    bare = s.strip("*#>-–|•· ").rstrip(".!…。！:; ").strip()
    if any(FORM.fullmatch(x) for x in (s, s.strip("*#> "), bare)):
        return "form", n, 0
    kind = notice(tokens)
    if kind in ("error", "script"):
        return kind, n + 1, 0
    if kind == "ask" or not any(c.isalpha() for c in bare):
        return "chrome", 0, 0
    if LABEL.fullmatch(s) and n <= 4:
        return "label", 0, n
    return "content", 0, n


def slot_lines(line: str) -> bool:
    """Whether an unresolved template field stands in a line: not in inline code or quotes, not in a line of code, and not in one that speaks of slots."""
    if not any(map(line.__contains__, _SLOT_CHARS)) or not _SLOT_SIGN.search(line):
        return False
    plain = _QUOTED.sub(lambda m: m[0] if m[0][0] == "«" else " ", _INLINE.sub(" ", line))
    rest, n = SLOTS.subn(" ", plain)
    return bool(n) and not SPEAKS.search(rest) and not CODE_LINE.search(plain if "${" in plain else rest)


#: Subjects of commits are content; only slots are looked for in them.
_COMMIT = re.compile(r"(?:feat|fix|docs|chore|perf|refactor|tests?|build|ci|style|revert)(?:\([^)]*\))?!?: ")
_SLOT_CHARS = ("{", "<", "%", "$", "@", "__", "[", "«", "ME", "THIS")
_SLOT_SIGN = re.compile(r"\{[{%]|<%|[$#]\{|%%|@@|\$\w+\$|__\w|«|\[(?:your|insert|enter|add|fill|replace|put)|here[\]>]|<(?:your|insert|enter|add|replace)|(?:replace|change|fill)_?(?:me|this)|\{(?:your|insert)", re.I)


_QUOTE_SIGNS = ('"', " '", "“", "„", "«", "「", "『")


def unquoted(line: str) -> str:
    """A line without markup; quotations and inline code are masked."""
    if "<" in line:
        line = _TAGS.sub("\n", line)
    if "`" in line:
        line = _INLINE.sub("\ue000", line)
    return _QUOTED.sub("\ue001", line) if any(map(line.__contains__, _QUOTE_SIGNS)) or line[:1] == "'" else line


def sentences(line: str) -> Iterator[tuple[str, int, bool]]:
    """Sentences of a line, their words, and whether they can be notices or of a form; without navigation and ids.

    What has none of the words that say that something is wrong can be none, nor
    what the lexicon does not cover nearly throughout; navigation beside a title
    in the same line leaves more room.
    """
    cjk_line = not line.isascii() and bool(_CJK.search(line))
    for part in (x for y in _SENTENCE.split(line) for x in _CJK_SENTENCE.split(y)) if cjk_line else _SENTENCE.split(line):
        words = part.lower().translate(_SPACED).split()
        kinds = set(words)
        form = _FORM_START.match(part)
        if not form:
            if cjk := cjk_line and bool(_CJK.search(part)):
                able = bool(_CJK_CORE.search(part)) or not kinds.isdisjoint(_SCRIPTS)
            else:
                able = not kinds.isdisjoint(_SAYS) or not kinds.isdisjoint(_NOTS) and not kinds.isdisjoint(_OF_NOTS) or len(words) <= 3 and bool(_STATUS.search(part))
                if able and (loose := len(words) - sum(map(_COVERED.__contains__, words))) > 0.2 * len(words) + 2:
                    # numbers, ids and paths are no words
                    loose -= len(words) - sum(map(str.isalpha, words)) + 4 * part.count("/")
                    able = loose <= 0.2 * len(words) + (2 if kinds.isdisjoint(_NAVS) else 8)
            if not able:
                if not kinds.isdisjoint(_AROUND) and len(part) <= 80:
                    part = CHROME.sub(" ", part)
                    words = part.lower().translate(_SPACED).split()
                if words and (len(words) > 10 or kinds.isdisjoint(_ASKS) or not _ASK_LINE.issuperset(words)):
                    yield part, n_words(part) if cjk else len(words), False
                continue
        for p in (c for q in (CHROME.split(part) if form or not kinds.isdisjoint(_AROUND) else (part,)) if q for c in _CLAUSE.split(q)):
            p = p.strip(" |·•\t")
            while p and " " in p and (cut := _NAV_AT_END.sub("", p).strip()) != p:
                p = cut
            if p:
                yield p, 0, True


def prose_lines(text: str) -> list[str]:
    """Lines without fenced code, and without indented code where unindented prose stands beside it; markup is no prose.

    A fence that is never closed is none: what follows it counts.
    """
    flush, indented, prose = [], [], False
    raws = text.replace("\r\n", "\n").split("\n")
    fences = [i for i, raw in enumerate(raws) if raw.lstrip().startswith(("```", "~~~"))]
    last = fences[-1] if len(fences) % 2 else None
    inside = False
    for i, raw in enumerate(raws):
        if raw.lstrip().startswith(("```", "~~~")):
            inside = not inside and i != last
            continue
        line = raw.strip()
        if inside or not line:
            continue
        if raw.startswith(("    ", "\t")):
            indented.append((i, line))
        else:
            flush.append((i, line))
            prose = prose or (not line.startswith("<") and any(c.isalpha() for c in line))
    return [line for _, line in (flush if prose else sorted(flush + indented))]


def parts_of(text: str) -> tuple[dict[tuple, int], int]:
    """What of a text can be residue, with the times it stands there, and the number of its other words."""
    plain, found = 0, {}

    def note(*key) -> None:
        found[key] = found.get(key, 0) + 1

    for line in prose_lines(text):
        if slot := slot_lines(line):
            note("", "", "slot", 0)
        if _COMMIT.match(line):
            plain += 0 if slot else len(line.split())
            continue
        words = line.lower().split()
        kinds = set(words)
        bare = unquoted(line)
        function = not kinds.isdisjoint(FUNCTION)
        if not function or len(kinds) <= len(words) // 3 or not kinds.isdisjoint(_FILLS):
            plain_words = _WORD.findall(bare)
            if is_filler(plain_words):
                low = {w.lower() for w in plain_words}
                note("", " ".join(sorted(low)) if not low.isdisjoint(LOREM) else "", "filler", len(plain_words))
                continue
            if len(plain_words) >= 4 and not function and line.isascii():
                note("", " ".join(w.lower() for w in plain_words), "bare", len(plain_words))
        for s, n, able in sentences(bare):
            if able:
                note(tree_path(masked(s)), s, "sentence", 0)
            elif not (n <= 4 and LABEL.fullmatch(s)):
                plain += n
    return found, plain


def document_parts(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, part, kind, words, times: what of each text can be residue, and the number of all its other words.

    Parts of kind 'sentence' are to be mined, with the path of the prefix tree
    that they belong to; 'filler' and 'bare' are whole lines of filler words,
    and without function words; 'slot' is a line with an unresolved field;
    'plain' stands for all other words of the text. A text in which nothing can
    be residue gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                found, plain = parts_of(text or "")
                if found:
                    rows += [(doc, *k, n) for k, n in found.items()]
                    rows.append((doc, "", "", "plain", plain, 1))
            yield pd.DataFrame(rows, columns=["doc_id", "leaf", "part", "kind", "words", "times"])

    return docs.select("doc_id", "text").where("trim(text) <> ''").mapInPandas(run, "doc_id bigint, leaf string, part string, kind string, words int, times int")


DEPTH = 3


def tree_path(tokens: list[str]) -> str:
    """Path in the prefix tree: the number of tokens and the first of them; words outside the lexicon are variable."""
    return f"{len(tokens)}\x01" + "\x01".join(t if t in LEXICON or t[0] == "<" else "<*>" for t in tokens[:DEPTH])


def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sentences of a leaf, in order, to templates and their verdicts.

    A sentence joins the template with which it shares every fixed word in its
    place; words outside the lexicon become variable. No two sentences of a
    template can differ in the verdict, which reads fixed words only, so a
    template is classified when it is founded, wherever its leaf is mined. Lines
    that begin like a form's are judged each, as signs are no words.
    """
    known: dict[tuple, tuple] = {}
    leaf = None
    for pdf in batches:
        out = []
        for path, sentence in zip(pdf["leaf"], pdf["part"], strict=True):
            if path != leaf:
                leaf, known = path, {}
            tokens = masked(sentence)
            template = tuple(t if t in LEXICON or t[0] == "<" else "<*>" for t in tokens)
            key = (template, sentence if _FORM_START.match(sentence) else LABEL.fullmatch(sentence) is not None)
            verdict = known.get(key)
            if verdict is None:
                verdict = known[key] = classify(list(template), sentence)
            kind, bad, other = verdict
            n = max(1, n_words(sentence))
            out.append((sentence, " ".join(template), kind, bad and n + (kind != "form"), other and n))
        yield pd.DataFrame(out, columns=["part", "template", "verdict", "bad", "other"])


def judged_sentences(parts: DataFrame) -> DataFrame:
    """part, template, verdict, bad, other: each distinct sentence, mined in its leaf of the tree.

    A leaf of any size is spread by the sentences' hash; verdicts do not depend on it.
    """
    from weftgraph.session import shuffle_width

    width = shuffle_width(parts.sparkSession)
    distinct = parts.where("kind = 'sentence'").select("leaf", "part").distinct().withColumn("salt", F.pmod(F.xxhash64("part"), F.lit(16)))
    return distinct.repartition(width, "leaf", "salt").sortWithinPartitions("leaf", "salt", "part").select("leaf", "part").mapInPandas(mine, "part string, template string, verdict string, bad int, other int")


def _bare_filler(parts: DataFrame) -> DataFrame:
    """doc_id, words: lines without function words of which nine in ten words stand in lines known as pseudo-Latin."""
    known = parts.where("kind = 'filler' and part <> ''").select(F.explode(F.split("part", " ")).alias("w")).where("length(w) > 2").distinct()
    bare = parts.where("kind = 'bare'").select("part", F.col("words").alias("n")).distinct()
    hits = bare.select("part", "n", F.explode(F.split("part", " ")).alias("w")).join(known, "w").groupBy("part").agg(F.count(F.lit(1)).alias("hits"), F.max("n").alias("n")).where("hits >= 0.9 * n").select("part")
    return parts.where("kind = 'bare'").join(hits, "part", "left_semi").select("doc_id", (F.col("words") * F.col("times")).alias("bad"))


def residue_documents(docs: DataFrame, most_other: int = 12, most_before_form: int = 40) -> DataFrame:
    """Documents that are, or hold in place of content, residue: doc_id and why.

    Columns: doc_id, residue ('slots', 'error', 'script', 'filler', 'form').
    A document is residue if an unresolved slot stands in its prose; if a
    filler paragraph stands in it; if it has an error, script notice or form
    and at most ``most_other`` other words besides navigation and labels; or
    if at least two lines of an unfilled form follow a short introduction.
    Pseudo-Latin is known by its customary words; the other words of such
    paragraphs, gathered from all documents, tell the paragraphs that happen
    to lack the former. Null and blank texts never are residue, nor are
    documents that consist of code. Repeated doc_ids are judged together. All
    of a text that is no code counts; lines without any word of notices, slots,
    filler or forms are only counted.
    """
    from weftgraph.session import checkpointed

    parts = checkpointed(document_parts(docs))
    sentences_ = parts.where("kind = 'sentence'").select("doc_id", "part", "times").join(judged_sentences(parts), "part").select(
        "doc_id", "verdict", (F.col("bad") * F.col("times")).alias("bad"), (F.col("other") * F.col("times")).alias("other"), "times"
    )
    rest = parts.where("kind in ('plain', 'filler', 'slot')").select("doc_id", F.col("kind").alias("verdict"), (F.col("words") * F.col("times")).alias("bad"), F.lit(0).alias("other"), "times")
    bare = _bare_filler(parts).select("doc_id", F.lit("filler").alias("verdict"), "bad", F.lit(0).alias("other"), F.lit(1).alias("times"))
    v = F.col("verdict")
    total = lambda of, *kinds: F.sum(F.when(v.isin(*kinds), F.col(of)).otherwise(0))
    per = sentences_.unionByName(rest).unionByName(bare).groupBy("doc_id").agg(
        total("times", "slot").alias("slots"), *[total("bad", k).alias(k) for k in ("error", "script", "filler", "form")],
        total("times", "form").alias("form_lines"), (total("bad", "plain") + total("other", "content")).alias("content"),
    )
    small = F.col("content") <= most_other
    why = (
        F.when(F.col("slots") > 0, "slots").when((F.col("filler") >= 4) | (F.col("filler") >= 2) & small, "filler").when(small & (F.col("script") > 0), "script")
        .when(small & (F.col("error") > 0), "error").when(small & (F.col("form") > 0), "form")
        .when((F.col("content") <= most_before_form) & (F.col("form_lines") >= 2), "form")
    )
    return per.select("doc_id", why.alias("residue")).where(F.col("residue").isNotNull())


def templates(docs: DataFrame) -> DataFrame:
    """The message templates mined: template, verdict, n_sentences, n_documents."""
    from weftgraph.session import checkpointed

    parts = checkpointed(document_parts(docs))
    return (
        parts.where("kind = 'sentence'").select("doc_id", "part").join(judged_sentences(parts), "part")
        .groupBy("template", "verdict").agg(F.count_distinct("part").alias("n_sentences"), F.count_distinct("doc_id").alias("n_documents"))
    )
