"""Residue in words that no list was made from: pages of products, starters and community files, and files that only speak of such."""

import pytest

from palimpsest.llm import residue

PAGES = [
    "<html>\n<head><title>404 Not Found</title></head>\n<body>\n<center><h1>404 Not Found</h1></center>\n<hr><center>openresty/1.21.4.1</center>\n</body>\n</html>\n",
    '<!DOCTYPE HTML PUBLIC "-//IETF//DTD HTML 2.0//EN">\n<html><head>\n<title>403 Forbidden</title>\n</head><body>\n<h1>Forbidden</h1>\n<p>You don\'t have permission to access this resource.</p>\n<hr>\n<address>Apache/2.4.52 (Ubuntu) Server at files.example.org Port 443</address>\n</body></html>\n',
    '<?xml version="1.0" encoding="UTF-8"?>\n<Error><Code>AccessDenied</Code><Message>Access Denied</Message><RequestId>4442587FB7D0A2F9</RequestId><HostId>Ju2Yb9Q3wXz+LkP0aVtRrS8mEoC5=</HostId></Error>',
    "<?xml version='1.0' encoding='UTF-8'?><Error><Code>NoSuchKey</Code><Message>The specified key does not exist.</Message><Details>No such object: my-bucket/lib/a.js</Details></Error>",
    '<!doctype html><html lang="en"><head><title>HTTP Status 500 – Internal Server Error</title></head><body><h1>HTTP Status 500 – Internal Server Error</h1><hr class="line" /><p><b>Type</b> Exception Report</p><p><b>Description</b> The server encountered an unexpected condition that prevented it from fulfilling the request.</p><p><b>Note</b> The full stack trace of the root cause is available in the server logs.</p><h3>Apache Tomcat/9.0.65</h3></body></html>',
    "<h2>404 - File or directory not found.</h2>\n<h3>The resource you are looking for might have been removed, had its name changed, or is temporarily unavailable.</h3>\n",
    "<h1>Sorry, you have been blocked</h1>\n<h2>You are unable to access example.com</h2>\n<p>This website is using a security service to protect itself from online attacks. The action you just performed triggered the security solution.</p>\n<p>Cloudflare Ray ID: 7d2f1c0b9e8a4f11</p>\n",
    "<html><body><h1>503 Service Unavailable</h1>\nNo server is available to handle this request.\n</body></html>\n",
    "<h1>Whitelabel Error Page</h1><p>This application has no explicit mapping for /error, so you are seeing this as a fallback.</p><div>There was an unexpected error (type=Not Found, status=404).</div>",
    '{"message":"API rate limit exceeded for 203.0.113.9. (But here\'s the good news: Authenticated requests get a higher rate limit. Check out the documentation for more details.)","documentation_url":"https://docs.example.com/rest"}',
    '{"message": "Not Found", "documentation_url": "https://docs.example.com/rest/repos", "status": "404"}',
    "<!DOCTYPE html>\n<html>\n<head><title>Error</title></head>\n<body>\n<pre>Cannot GET /static/js/app.js</pre>\n</body>\n</html>\n",
    "<h1>Server Error (500)</h1>\n",
    "<h1>We're sorry, but something went wrong.</h1>\n<p>If you are the application owner check the logs for more information.</p>\n",
    "The page you were looking for doesn't exist.\nYou may have mistyped the address or the page may have moved.\n",
    "upstream connect error or disconnect/reset before headers. reset reason: connection failure",
    "<title>Site Not Found</title><h1>Site Not Found</h1><p>Well, this is awkward. The site you're looking for is not here.</p><p>Is this your site? Get more info or contact support.</p>",
    "404: NOT_FOUND\nCode: NOT_FOUND\nID: fra1::7x2mq-1712000000000-1a2b3c4d5e6f\n",
    "<H1>Access Denied</H1>\n\nYou don't have permission to access \"http&#58;&#47;&#47;www&#46;example&#46;com&#47;\" on this server.<P>\nReference #18.5e7d1702.1712000000.1a2b3c4d\n",
    "<h1>Error 503 Backend fetch failed</h1>\n<p>Backend fetch failed</p>\n<h3>Guru Meditation:</h3>\n<p>XID: 98435</p>\n<hr>\n<p>Varnish cache server</p>\n",
    "<h1>ERROR: The requested URL could not be retrieved</h1>\n<p>The following error was encountered while trying to retrieve the URL: http://example.com/</p>\n<p>Unable to determine IP address from host name.</p>\n",
    "Request Blocked. The request could not be satisfied. We can't connect to the server for this app or website at this time. There might be too much traffic or a configuration error. Try again later, or contact the app or website owner.\n",
    "<h1>Too Many Requests</h1><p>We have received too many requests from your network. Please wait a few minutes and try again.</p>",
    "Repository unavailable due to DMCA takedown. This repository has been disabled.\n",
    "# Page introuvable\n\nLa page que vous demandez n'existe pas.\n",
    "Die angeforderte Seite wurde nicht gefunden.\n",
    "Lo sentimos, la página que busca no existe.\n",
    "Страница не найдена. Попробуйте позже.\n",
    "Error establishing a database connection\n",
    "An error occurred while processing your request. Reference number: 0.5c3e1202\n",
]
NOTICES = [
    "You need to enable JavaScript to run this app.",
    "<noscript><strong>We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.</strong></noscript>\n<div id=\"app\"></div>",
    "Enable JavaScript and cookies to continue",
    "JavaScript is not available. We've detected that JavaScript is disabled in this browser. Please enable JavaScript or switch to a supported browser to continue.",
    "JavaScript must be enabled in order for you to use this site. However, it seems JavaScript is either disabled or not supported by your browser.",
    "This site requires Javascript to be enabled in your browser settings.",
    "Please turn JavaScript on and reload the page.",
    "<html><body><h1>Just a moment...</h1><p>Checking your browser before accessing the site. This process is automatic.</p><p>Please enable Cookies and reload the page.</p></body></html>",
    "Your browser does not support JavaScript!",
    "For full functionality of this site it is necessary to enable JavaScript.",
    "This application works best with JavaScript enabled.",
    "Sorry, this page needs scripting to be turned on.",
    "Bitte aktivieren Sie JavaScript in Ihrem Browser.",
    "Veuillez activer JavaScript pour continuer.",
    "Por favor, habilite JavaScript para ver esta página.",
    "Для работы сайта включите JavaScript в вашем браузере.",
]
# Written after the lists, before they were widened: 17 of these 35 were found at first, 50 of the 67 others.
SECOND = [
    "<h1>502 Bad Gateway</h1>\n<p>The proxy server received an invalid response from an upstream server.</p>\n",
    "<title>Error 522</title><h1>Connection timed out</h1><p>The initial connection between Cloudflare's network and the origin web server timed out. As a result, the web page can not be displayed.</p>",
    '{"error":"not_found","reason":"missing"}',
    '{"errors":[{"code":"UNAUTHORIZED","message":"authentication required","detail":null}]}',
    "<Error><Code>InvalidBucketName</Code><Message>The specified bucket is not valid.</Message></Error>",
    "HTTP Error 400. The request hostname is invalid.",
    "<h1>Not Found</h1>\n<p>The requested URL was not found on the server. If you entered the URL manually please check your spelling and try again.</p>\n",
    "<h1>Page not found at /about/</h1><p>You're seeing this error because you have DEBUG = True in your settings file.</p>",
    "Application error: a client-side exception has occurred (see the browser console for more information).",
    "<h1>This page isn't working</h1><p>example.com is currently unable to handle this request.</p><p>HTTP ERROR 500</p>",
    "Oops! Google Chrome could not find www.example.com\n",
    "Sorry, the page you were trying to view does not exist.\n",
    "We'll be back soon! Sorry for the inconvenience but we're performing some maintenance at the moment.\n",
    "Service Unavailable - DNS failure\nThe server is temporarily unable to service your request. Please try again later.\nReference #11.2f9c1702.1712000000.55\n",
    "<h1>Site under maintenance</h1><p>Please come back later.</p>",
    "File not found.\n",
    "<html><body><h1>It works!</h1></body></html>".replace("It works!", "408 Request Time-out") ,
    "Rate limit exceeded. Please wait 60 seconds before making another request.\n",
    "You have exceeded your daily download quota. Upgrade your plan to continue.\n",
    "fatal: repository not found\n",
    "Das angeforderte Dokument existiert nicht.\n",
    "Accès refusé. Vous n'avez pas l'autorisation d'accéder à cette page.\n",
    "Página não encontrada. Desculpe, o endereço não existe.\n",
    "お探しのページが見つかりません。\n",
    "抱歉，您访问的页面不存在。\n",
    "Please enable JS and disable any ad blocker",
    "<noscript>You must have JavaScript enabled to use this form.</noscript>",
    "This website uses JavaScript. Please activate it in your browser.",
    "JavaScript Required. Sorry, but this page requires a JavaScript-enabled browser.",
    "We have detected that you have JavaScript turned off. Turn it on to get the best experience.",
    "Om deze pagina te bekijken moet u JavaScript inschakelen.",
    "Per utilizzare questo sito è necessario abilitare JavaScript.",
    "Ative o JavaScript para usar esta página.",
    "请启用JavaScript以继续访问本网站。",
    "이 페이지를 보려면 JavaScript를 활성화하세요.",
]
SLOTS = [
    ("README.md", "# {{ cookiecutter.project_slug }}\n\nA tool.\n"), ("setup.cfg", "[metadata]\nname = {{ cookiecutter.pypi_name }}\n"), ("CODE_OF_CONDUCT.md", "Instances of abuse may be reported at [INSERT CONTACT METHOD].\n"),
    ("SECURITY.md", "Please report it to <INSERT EMAIL ADDRESS HERE>.\n"), ("README.md", "# Pump\n\nTODO: Write usage instructions here\n"), ("App.csproj", "<RootNamespace>$safeprojectname$</RootNamespace>\n"),
    ("README.md", "Copyright [yyyy] [name of copyright owner]\n"), ("config.yaml", "owner: <your-github-username>\nport: 80\n"), ("README.md", "Maintained by [Your Name Here]\n"), ("docs/index.md", "Write to [insert support address] for help.\n"),
    ("package.json", '{\n  "name": "<%= name %>",\n  "author": "<%= author_name %>"\n}\n'), ("pom.xml", "<artifactId>${artifactId}</artifactId>\n<groupId>${groupId}</groupId>\n"), ("README.md", "# {{cookiecutter.repo_name}}\n"), ("app.toml", 'title = "REPLACE_ME"\n'),
]
FILLERS = [
    "# Valve\n\nSed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.\n", "# Valve\n\nAt vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum.\n",
    "<h1>Valve</h1><p>Curabitur blandit tempus porttitor. Vestibulum id ligula porta felis euismod semper. Lorem ipsum dolor sit amet, consectetur adipiscing elit.</p>", "# Pump\n\nThis is placeholder text.\n", "# Pump\n\nOne Paragraph of project description goes here\n",
    "# Pump\n\nThe quick brown fox jumps over the lazy dog. The quick brown fox jumps over the lazy dog.\n", "# Pump\n\nYour content goes here.\n",
]
SPOKEN_OF = [
    ("docs/errors.md", "# Errors\n\nThe gateway answers 404 when a valve is unknown.\n\n## Causes\n\nA pump that was never primed gives 503 and the gauge stays at zero until it is.\n"),
    ("docs/faq.md", "## Why do I see \"Access denied\"?\n\nYour key ring lacks the role for that valve; ask the plant engineer to add you to the crew.\n"), ("app.py", 'def page():\n    abort(404, "The requested page was not found")\n'),
    ("errors.go", 'package errors\n\n// ErrNotFound says that the page was not found.\nvar ErrNotFound = New("not found")\n'), ("a.ts", "export class NotFound extends Error {\n  message = 'Not found';\n}\n"),
    ("en.json", '{\n  "pump.denied": "Access denied",\n  "valve.gone": "The page could not be found",\n  "gauge.ok": "The gauge reads well"\n}\n'), ("base.html", "<body>{{ content }}<footer>{{ year }} pumps and valves</footer></body>".replace("{{ year }}", "2024")),
    ("index.html", "<html><body><h1>Gauges</h1><p>The gauge reads the valve and tells the pump what to do next.</p><noscript>You need to enable JavaScript to run this app.</noscript></body></html>"),
    ("deploy.yaml", "image: pump:${{ github.sha }}\nenv:\n  VALVE: ${VALVE}\n"), ("a.sh", 'echo "404 not found" >&2\nexit 1\n'), ("README.md", "# Pump\n\nRun `echo __TITLE__` and replace `[INSERT NAME]` in the sheet.\n"),
    ("latin.md", "# Motto\n\nThe crew's motto is *festina lente*, which the foreman had carved above the door of the pump house.\n"), ("notes.md", "We were asked to enable JavaScript for the gauge panel, and the plant agreed last week.\n"),
    ("todo.py", "# TODO: drop the old valve\nx = 1\n"), ("CHANGELOG.md", "## 1.2\n\n- The valve no longer times out.\n- Fixed: page not found after sign in.\n"),
]


def recall(cases):
    missed = [c for c in cases if not residue.kinds_of(c[1], c[0])]
    return 1 - len(missed) / len(cases), missed


@pytest.mark.parametrize("cases", [[("a.py", p) for p in PAGES], [("a.html", p) for p in NOTICES], SLOTS, [("a.md", p) for p in FILLERS]], ids=["pages", "notices", "slots", "fillers"])
def test_recall_on_messages_of_others(cases):
    found, missed = recall(cases)
    assert found >= 0.85, missed


def test_recall_overall():
    cases = [("a.js", p) for p in PAGES] + [("a.js", p) for p in NOTICES + SECOND] + SLOTS + [("a.md", p) for p in FILLERS]
    found, missed = recall(cases)
    assert found >= 0.9, missed


@pytest.mark.parametrize(("path", "text"), SPOKEN_OF)
def test_files_that_speak_of_such(path, text):
    assert residue.kinds_of(text, path) == []
