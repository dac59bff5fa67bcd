"""What error pages, script notices, scaffolds and filler say.

Put together from public sources: the reason phrases of HTTP (RFC 9110 and its kin, as
the standard library lists them), the default pages of common servers, proxies, clouds
and frameworks, the notices of web application starters, the slots of common scaffold
tools and community files, and the two passages of Cicero that filler is made from.
Phrases are kept short, what is said of a thing apart from the thing, so that they meet
in sentences that no list has: the words in between are ``NEUTRAL``.
"""

from __future__ import annotations

from http import HTTPStatus
from itertools import product

#: Reason phrases, and what servers put in their place.
STATUS = sorted(
    {s.phrase.lower() for s in HTTPStatus if s >= 400}
    | {
        "page not found", "file not found", "access denied", "access forbidden", "permission denied", "service temporarily unavailable", "gateway time-out", "request time-out",
        "request timeout", "connection timed out", "origin dns error", "web server is down", "origin is unreachable", "invalid request", "authentication required", "login required",
        "no such key", "no such bucket", "no such file", "no such host", "resource not found", "server error", "internal error", "application error", "fatal error", "bad hostname",
        "too many redirects", "rate limit exceeded", "rate limit reached", "quota exceeded", "over quota", "limit exceeded", "not authorized", "whitelabel error page", "routing error",
        "whoops, looks like something went wrong", "server error in '/' application", "an unknown error", "unexpected error", "unknown error", "invalid url", "invalid token",
    }
)


def _made(*parts: tuple[str, ...]) -> list[str]:
    """Every phrase that takes one of each part."""
    return [" ".join(x) for x in product(*parts)]


#: What is wrong with a page or a server, without saying which.
WRONG = (
    *_made(("cannot be", "can't be", "can not be", "could not be", "couldn't be"), ("found", "reached", "read", "loaded", "displayed", "shown", "opened", "accessed", "served", "located", "retrieved", "resolved", "verified", "processed", "completed", "rendered", "fetched")),
    *_made(("no longer",), ("exists", "exist", "available", "here", "there", "online", "active", "at this address", "at this url", "at this location", "on this server", "part of", "supported")),
    *_made(("returned", "sent", "received", "got", "gave", "produced"), ("an invalid", "an unexpected", "an empty", "a bad", "no", "an unknown"), ("response", "reply", "answer")),
    *_made(("returned", "sent", "produced"), ("an error", "nothing", "an invalid header")),
    *_made(("refused", "rejected", "dropped", "declined"), ("the request", "the connection", "your request", "to connect", "this request")),
    *_made(("was", "were", "been", "is", "has been", "have been"), ("moved or removed", "moved or deleted", "removed or renamed", "renamed or removed", "renamed or deleted")),
    *_made(("may have been", "might have been", "could have been"), ("removed", "moved", "deleted", "renamed")),
    *_made(("over", "above", "beyond"), ("its limit", "its quota", "your limit", "your quota", "the limit", "the quota", "its capacity")),
    *_made(("too large", "too big", "too long"), ("to show", "to display", "to preview", "to render", "to view")),
    *_made(("sign in", "log in", "login", "authenticate"), ("to see", "to view", "to continue", "to access", "to proceed", "to read")),
    *_made(("until you", "before you"), ("sign in", "log in")),
    *_made(("page", "file", "resource", "url", "document", "object", "item", "content", "site"), ("you were looking for", "you are looking for", "you're looking for", "you requested", "you asked for", "you are trying to", "you tried to", "you were trying to", "you want")),
    *_made(("no such", "unknown", "nonexistent"), ("revision", "repository", "object", "page", "resource", "path", "route", "branch", "commit", "document", "user", "project", "package", "version")),
    *_made(("the specified", "specified"), ("key", "bucket", "object", "resource", "blob", "container")),
    *_made(("be back", "back online", "back up", "return"), ("soon", "shortly", "in a moment", "in a few minutes")),
    *_made(("more requests", "too many requests", "requests too", "too many connections"), ("than", "from", "quickly", "fast")),
    *_made(("right now", "at this time", "at the moment", "for now"), ("unavailable", "not available", "offline")),
    "was not found", "were not found", "is not found", "wasn't found", "not be located",
    "does not exist", "doesn't exist", "do not exist", "did not exist", "does not appear to exist", "doesn't appear to exist", 
    "is not available", "isn't available", "is unavailable", "not available", "temporarily unavailable", "currently unavailable", "is not accessible", "is not valid",
    "has been moved", "has been removed", "has been deleted", "has been disabled", "has been suspended", "has been blocked", "has been denied", "has been archived", "have been blocked",
    "have been removed", "was removed", "was deleted", "was blocked", "was denied", "was rejected", "was moved", "had its name changed",
    "is private", "is down for maintenance", "is down", "under maintenance", "is offline", "went offline", "undergoing maintenance", "scheduled maintenance", "is invalid", "http error", "exception has occurred", 
    "is unreachable", 
    "closed the connection", "unexpectedly closed", "is not responding", "not responding", "did not respond", "didn't respond", "took too long to respond", "timed out", "time limit exceeded",
    "couldn't load", "could not load", "failed to load",
    "failed to fetch", 
    "encountered an error", "encountered an internal error", "encountered an unexpected condition", "misconfiguration and was unable",
    "prevented it from fulfilling", "unable to complete your request", "unable to process your request", "unable to handle this request", "unable to handle the request", "unable to service your request",
    "unable to connect", "unable to fetch", "unable to find", "unable to load", "unable to retrieve", "unable to verify", "could not process", "could not complete", "could not connect", "could not resolve",
    "could not understand", "could not verify", "could not satisfy", "couldn't find", "could not find", "cannot find", "can't find", "cannot serve", "not understand",
    "is forbidden", "is restricted", "is denied", "is not allowed", "not allowed to access", "is not permitted", "are not permitted", "is not supported", "not supported for", "is not authorized",
    "are not authorized", "aren't authorized", "do not have permission", "don't have permission", "does not have permission", "do not have access", "don't have access", "lacks permission", "need permission",
    "not have the required", "must be authenticated", "requires authentication", "must be logged in", "must be signed in", "need to sign in", "need to log in", 
    "session has expired", "session has ended", "session expired", "token has expired", "link has expired", "link is broken", "broken link", "this link may be broken",
    "sent too many requests", "too many requests", "exceeded a secondary rate limit", "exceeded the rate limit", "exceeded your", "rate limit", "slow down",
    "an error occurred", "an error has occurred", "error occurred while processing", "error was encountered while", "there was an error", "there was a problem", "there has been a critical error", "we encountered a problem",
    "something went wrong", "something has gone wrong", "things went wrong", "went wrong on our", "server logs", "server administrator", "site administrator", "site owner", "webmaster", "ray id", "reference #",
    "no server is available", "no healthy upstream", "no healthy backends", "upstream connect error", "overloaded", "over capacity", "heavy load", "no explicit mapping for", "seeing this as a fallback",
    
    "site can't be reached", "try again later", "try again in a few", "try again in 30 seconds", "please try again", "please retry", "try reloading", "try refreshing", "check the url", "check the address", "mistyped the address",
    "typed the address", "page may have moved", "may have moved", "nothing here", "nothing was found",
    "does not match any", "security service to protect itself", "triggered the security solution",
    "you are unable to access", "attention required", "error establishing a database connection", "there isn't a github pages site here", "request could not be satisfied", "cannot get /", "cannot post /", "cannot head /",
    "you have been blocked", "used cloudflare to restrict access", "banned your access", "incident id", "fault filter abort", "varnish cache server", "guru meditation", "origin web server", "bad request to",
)

#: The same in other languages, and what of them starts or ends such a page.
WRONG_ELSEWHERE = (
    "nicht gefunden", "zugriff verweigert", "zugriff verboten", "nicht verfügbar", "interner serverfehler", "existiert nicht", "nicht erreichbar", "wartungsarbeiten", "keine berechtigung",
    "non trouvée", "non trouvé", "introuvable", "accès refusé", "accès interdit", "n'existe pas", "n'existe plus", "erreur interne", "indisponible", "en maintenance", "n'avez pas l'autorisation",
    "no encontrada", "no encontrado", "no se encontró", "no se ha encontrado", "acceso denegado", "no existe", "no disponible", "error interno", "en mantenimiento", "no tiene permiso",
    "não encontrada", "não encontrado", "acesso negado", "não existe", "indisponível", "erro interno", "em manutenção", "não tem permissão",
    "non trovata", "non trovato", "accesso negato", "non esiste", "non disponibile", "errore interno", "in manutenzione",
    "не найдена", "не найден", "не найдено", "доступ запрещен", "доступ запрещён", "не существует", "недоступен", "недоступна", "ошибка сервера", "внутренняя ошибка", "технические работы",
    "niet gevonden", "toegang geweigerd", "bestaat niet", "niet beschikbaar", "nie znaleziono", "odmowa dostępu", "nie istnieje", "hittades inte", "åtkomst nekad", "bulunamadı", "erişim engellendi",
    "見つかりません", "アクセスが拒否", "存在しません", "サーバーエラー", "メンテナンス中", "利用できません", "页面不存在", "找不到页面", "未找到", "访问被拒绝", "不存在", "服务器错误", "無法找到", "拒絕存取",
    "찾을 수 없습니다", "접근이 거부", "존재하지 않", "서버 오류", "사용할 수 없습니다",
)

#: Names of scripts, and what notices say of them, before or behind.
_SCRIPTS = ("javascript", "java script", "scripts", "scripting", "client-side scripts", "client-side scripting", "client side scripting", "active scripting", "client scripts")
_BEFORE = (
    "enable", "enabled", "enabling", "enables", "turn on", "turned on", "turning on", "switch on", "switched on", "allow", "allows", "allowing", "activate", "activating", "require", "requires", "required", "need", "needs",
    "use", "uses", "run", "running", "without", "works best with", "must have", "have", "support", "supports", "supporting", "not support", "blocked", "blocks", "has blocked", "disabled", "has disabled", "blocking", "is not running", "depends on", "on",
)
_BEHIND = (
    "is disabled", "are disabled", "required", "is required", "are required", "is needed", "is not enabled", "isn't enabled", "is turned off", "are turned off", "is off", "are off", "is blocked", "are blocked", "is not available",
    "must be enabled", "must be turned on", "must be on", "must be switched on", "should be enabled", "needs to be enabled", "has to be enabled", "to be enabled", "enabled", "disabled", "support", "turned on", "switched on", "is not supported",
)
NOTICE = (
    *(f"{b} {s} on" for b, s in product(("turn", "switch"), _SCRIPTS)),
    *(f"{b} {s}" for b, s in product(_BEFORE, _SCRIPTS)),
    *(f"{s} {b}" for s, b in product(_SCRIPTS, _BEHIND)),
    *(f"{b} {s}" for b, s in product(("enable", "allow", "turn on", "requires"), ("js", "cookies", "cookies and javascript"))),
    "checking your browser", "checking if the site connection is secure", "verify you are human", "verifying you are human", "doesn't work properly without", "does not work properly without", "won't work without", "does not work without", "not work without",
    "cannot be shown without", "your browser does not support", "browser is not supported", "unsupported browser", "outdated browser", "scripts and cookies", "javascript and cookies", "cookies must be",
)
NOTICE_ELSEWHERE = (
    "javascript aktivieren", "aktivieren sie javascript", "javascript einschalten", "javascript ein", "javascript ist deaktiviert", "javascript benötigt", "benötigt javascript", "ohne skripte", "ohne javascript", "skripte",
    "activer javascript", "activez javascript", "activer le javascript", "javascript est désactivé", "javascript est requis", "sans javascript", "nécessite javascript",
    "active javascript", "activar javascript", "activa javascript", "habilite javascript", "habilitar javascript", "javascript está desactivado", "requiere javascript", "sin javascript",
    "ative o javascript", "ativar o javascript", "ativar javascript", "habilite o javascript", "javascript está desativado", "requer javascript", "sem javascript",
    "attivare javascript", "attiva javascript", "abilita javascript", "abilitare javascript", "javascript è disabilitato", "richiede javascript",
    "включите javascript", "включить javascript", "javascript отключен", "требуется javascript", "без javascript", "schakel javascript in", "javascript inschakelen", "javascript is uitgeschakeld", "włącz javascript", "włączyć javascript", "aktivera javascript", "javascript'i etkinleştirin",
    "javascriptを有効", "javascriptが無効", "javascriptが必要", "启用javascript", "启用 javascript", "開啟javascript", "開啟 javascript", "javascript를 활성화", "javascript를 사용", "javascript가 필요",
)

#: Words that pages are made of beside their phrases: those of English grammar, of the web, and of politeness.
NEUTRAL = frozenset(
    (
        "a about accept access account action additionally address administrator again all allow allowed also am an and another any anything api app application apologies apologize appears are as asked at attempt attempting author available back be because been before "
        "below blob branch browse browser bucket but by cache can cannot caused check click client cloud code com commit complete conditions config configuration connect connection contact contain contains content continue cookie cookies could couldn "
        "current currently data description detail details did directory do docs document documentation does doesn doing domain don due either email encountered end enough entered error errordocument errors even exception expected experiencing "
        "failed failure few file files find fix client side following follow for forbidden found fulfilling full further gateway get give go going gone great guest had handle has have haven having help here hint homepage host hosted hosting hour hours how however http https i identifier "
        "id if immediately improve in information inconvenience incorrect index individual info inform instead internal internet into invalid is isn issue issues it item its itself json just key know language later learn let level like line link listed load loading log "
        "logged login logs look looking looks made mail make manager may maybe me means minimum menu message meantime method minute minutes mirror mistake mistyped missing moment moments more most moved must my name need needed network new no not note nothing notice notified number object of off "
        "official oh ah uh hmm on once one online only open or order origin other our out owner oops page pages parameter passed password path perform permission permissions permitted permits please policy post powered preferences previous private problem problems proceed processing project "
        "properly protected protocol proxy public python raw re reach ready reason received redirect reference refresh reload reloading rendering repo report repository request requestid requested requesting requests required resolve resource resources response rest result results retry return "
        "returned revision right root route run save saved search seconds section secure security see seem seems sent server servers service services session set settings shortly should show shows sign signed site sites snapshot so some something sorry soon source specified stack start "
        "status still submitted such supplied support sure system take taken team temporary terms than thank thanks that the their them then there these they thing things this those time title to token too trace try trying type typed unable unexpected unfortunately uh until up update updated upgrade "
        "upstream url use used user username using usually valid value version very via view viewer viewing visit visited visitor wait want was way we web webpage website website's welcome well were what when where whether which while who whoops why will window wish with without working would wrong xml "
        "fatal hostname dokument documento documento fichero back inconvenience moment best above across after against along among around automatic automatically away between beyond both but each else ever every from front good had hers him his into least less lot many might much near necessary never next news none nor often onto other others ought over own part per perhaps possible quite rather same several shall she "
        "since soon still through throughout together toward under until upon upper us usually well within http ip network networks traffic reset header headers authenticate authenticated authentication authorization authorized credentials retrieve retrieved determine functionality necessary necessarily automatically accessing process processed "
        "javascript js scripts script scripting blocked block blocker blocking disable disabled enabling enable enabled turned turn switch switched different supported unsupported proceed allow allowed ad ads static higher lower free plan daily quota download making another manually spelling come console exception client handle browser chrome firefox safari edge "
        "dns initial between experience best detected form visit missing takedown legal dmca debug seeing maintenance performing unavailable again later "
        "yet you your yourself yours zone hostid accessdenied nosuchkey xhtml html utf english encountered openresty nginx apache tomcat jetty iis microsoft caddy cloudflare cloudfront varnish gunicorn werkzeug ubuntu debian centos unix linux port java lang spring django laravel express rails heroku netlify"
    ).split()
    # The small words of other languages that their notices use.
    + (
        "angeforderte angeforderten gesuchte aufgerufene versuchen später erneut bitte schalten sie die der das diese dieser seite datei um zu sehen sie in ihrem browser ist wurde kann nicht angezeigt werden fehler anzuzeigen für auf verwenden und "
        "que qui demandez demandée demandé cherchez réessayer plus tard pas n'avez d'accéder à l'accès veuillez la le les cette ce page fichier pour afficher dans votre navigateur vous est sont erreur utiliser continuer et de du des l désolé "
        "que busca buscas solicitada solicitado intente inténtelo más tarde solicitou procura tente novamente endereço servidor usar por favor el los las esta este página archivo para ver en su navegador usted ha lo sentimos y usar continuar o a da do no seu navegador arquivo esse desculpe e "
        "richiesta richiesto cercata riprova più tardi utilizzare necessario per vedere questa pagina bisogna il lo del nel tuo è si prega di visualizzare questo sito "
        "попробуйте позже запрошенная запрошенный работы сайта работа обновите для просмотра файла страница страницы этой на в вашем браузере пожалуйста чтобы продолжить и сайт "
        "moet u opgevraagde later opnieuw deze pagina om te bekijken uw in het een proszę stronę aby w przeglądarce ta strona för att visa sidan denna din webbläsare lütfen bu sayfayı"
    ).split()
)
#: Of them, those that make a line a statement about such a case rather than the case.
CONDITIONAL = frozenset("if when whether while because instead unless return returned returns result results exception handle so then than then what where which who why how get set".split())

#: What scaffold tools ask for, for syntaxes that files also use for values of their own.
FIELDS = (
    "app name", "app title", "application name", "artifact id", "author", "author email", "author name", "class name", "company", "company name", "component", "component name", "contact email", "contact method", "copyright holder", "copyright year",
    "description", "email", "email address", "entry point", "full name", "fullname", "group id", "holder", "homepage", "library name", "licence", "licence name", "license", "license name", "maintainer", "maintainer email", "module name",
    "organisation", "organization", "organization name", "owner", "owner team", "package", "package name", "package version", "plugin name", "product name", "project", "project description", "project name", "project slug", "project title", "project url", "repo",
    "repo name", "repo slug", "repo url", "repository", "repository name", "repository url", "service", "service name", "short description", "short summary", "site name", "slug", "summary",
    "support contact", "support email", "team", "team name", "theme name", "title", "url", "username", "user name", "version", "website", "website url", "year", "your name",
)
#: Ways to write an open slot, for names with underscores, with blanks, with dashes.
SNAKE = ("{{ %s }}", "{{%s}}", "{%% %s %%}", "#{%s}", "${%s}", "%%%s%%", "$$%s$$", "@@%s@@", "__%s__", "%s_placeholder", "placeholder_%s", "replace_me_%s", "change_me_%s", "your_%s_here", "<%%= %s %%>", "<%%=%s%%>", "$%s$", "[%%%s%%]")
SPACED = ("[[%s]]", "[[ %s ]]", "[your %s]", "[insert %s]", "[insert %s here]", "<your %s here>", "<your %s>", "<insert %s>", "<insert %s here>", "«%s»", "[%s here]", "<%s here>", "[enter %s]", "[add %s]", "<enter %s>", "<add %s>", "(insert %s here)", "{insert %s}", "{your %s}")
KEBAB = ("todo-%s-here", "your-%s-here", "replace-me-%s", "your-%s")
#: Objects that only scaffold tools have, with any name behind the dot.
OWNERS = ("scaffold", "cookiecutter", "template", "project", "copier", "schematic", "archetype", "yeoman", "plop")
#: Beginnings of slots with any words in them, and how they go on.
OPEN_SLOTS = (
    r"\{\{[-~]?\s*(?:cookiecutter|copier__\w+|scaffold|_copier_conf)\s*[.\[]\s*['\"]?\w+['\"]?\]?(?:\s*\|[^{}\n]*)?\s*[-~]?\}\}",
    r"\[\s*(?:insert|enter|your|add|put|fill in|replace with)\s(?:your\s)?[a-z][a-z \-/_']{1,40}\]", r"<\s*(?:insert|enter|your|add|put|fill in|replace with)\s(?:your\s)?[a-z][a-z \-/_']{1,40}>", r"\{\s*(?:insert|your)\s[a-z][a-z \-/_']{1,40}\}",
    r"<(?:your|insert)[_-][a-z_-]{2,40}>", r"\[(?:your|insert)[_-][a-z_-]{2,40}\]", r"\$safe(?:project|item)name\$|\$(?:project|item|solution)name\$|\$registeredorganization\$", r"<%=?\s*(?:classify|dasherize|camelize|underscore)\(\s*\w+\s*\)\s*%>",
    r"\[(?:yyyy|year)\]\s*\[(?:name of copyright owner|fullname|full name|your name)\]", r"\btodo:\s*(?:write|delete|replace|put|fill in|add|insert)\s(?:a|an|your|this|the|usage|some)\b[^\n]{0,80}", r"\b(?:replace|change)[_ -]?me\b(?![-_\w])",
)
#: What one of those needs to be looked for at all.
SLOT_HINTS = ("cookiecutter", "copier_", "scaffold.", "[insert ", "[enter ", "[your", "[add ", "[put ", "[fill in ", "[replace with ", "<insert", "<enter ", "<your", "<add ", "<put ", "<fill in ", "<replace with ", "{insert ", "{your ", "$safe", "name$", "<%=", "[yyyy]", "[year]", "todo: ", "replace_me", "replace me", "replace-me", "change_me", "changeme", "change-me", "change me", "replaceme")

#: Sentences of filler.
FILLER_SENTENCES = (
    *_made(("replace this",), ("text", "paragraph", "section", "sentence", "line", "content", "block"), ("with your own words", "with your own text", "with your own content", "with your text", "with real content")),
    *_made(("write", "add", "insert", "enter", "put", "type"), ("something", "some text", "text", "content", "your text", "your content", "a few words", "a description", "details"), ("here", "about this section", "about this", "in this section")),
    *_made(("text", "content", "description", "your text", "your content", "your description", "body text", "section text", "more text", "title", "some text"), ("goes here", "here")),
    *_made(("placeholder", "dummy", "sample", "filler", "example"), ("text", "content", "paragraph", "copy", "sentence")),
    *_made(("replace this",), ("text", "paragraph", "placeholder")),
    "coming soon", 
    "this is a placeholder", "this is placeholder text", 
    "lorem ipsum", "to be written", "to be added later",
    "the quick brown fox jumps over the lazy dog", "bacon ipsum", "your description here", "describe your project here", "short description of the project", "one paragraph of project description goes here",
    "hier steht ein text", "hier steht ihr text", "blindtext", "platzhaltertext", "texte à remplacer", "votre texte ici", "faux texte", "texto de ejemplo", "texto de relleno", "su texto aquí", "texto de exemplo", "seu texto aqui", "testo di prova", "testo segnaposto",
    "текст-заполнитель", "текст-рыба", "здесь будет текст", "ダミーテキスト", "ここにテキスト", "示例文本", "占位文本", "此处填写", "더미 텍스트", "샘플 텍스트",
)

# The passage of print shops, and the beginnings of the two sections of Cicero (De finibus I 10) it comes from.
PASSAGES = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo
consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo
nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit sed quia consequuntur magni dolores eos qui ratione sequi nesciunt
at vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi
"""
#: What generators add to them.
GENERATED = "ullam porta nunc mauris ligula ornare vestibulum pellentesque curabitur phasellus suspendisse vivamus praesent integer donec aenean morbi maecenas quisque faucibus tincidunt".split()
LATIN = frozenset(PASSAGES.split()) | frozenset(GENERATED)
#: Endings that most Latin words and few others have.
LATIN_ENDINGS = ("us", "um", "ur", "is", "it", "et", "am", "em", "que", "ae", "or", "unt", "ent", "ant", "ere", "isse", "ibus", "os", "as", "at", "ut", "io", "ia")
NOISE = frozenset("blah bla yada xxx tbd foo bar baz qux asdf qwerty".split())
