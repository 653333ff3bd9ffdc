"""Texts that hold template residue, filler or messages of the delivering site instead of content.

Character n-gram models are fitted for each kind of residue from the seed texts below and for natural prose from all
documents, where each wording counts once, however many documents show it. The models are fitted twice: first from the seeds
and all documents, then from the seeds, the wordings that were found in all documents and all documents again (self-training).
The wordings learned are counted in Spark; the driver sees their n-grams' sums and their fingerprints. The log likelihood ratio of residue to prose is taken for every n-gram of every text.
Windows of it find the lines that may hold residue; there each sentence, field value or heading is looked at by itself,
and what is covered by positive windows over (nearly) its whole length is residue. A sentence that quotes or treats a
notice or a field is covered in part only. What the windows find of open fields and empty values is then checked exactly: a
field has to stand as a whole, or within a sentence that doesn't treat it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.config import materialize
from rangeloom.operators.skewed_keys import _BLOCKS, BLOCK, _Dense, sum_blocks

ORDER = 4
SLOT_BITS = 22
#: The share below which an n-gram's frequency makes no difference.
FLOOR = 1e-7
#: Seen in no seed of a kind.
UNSEEN = -3.0
CEILING = 5.0
#: The log odds of prose to residue before anything is seen.
PRIOR = 2.0
#: A line is looked at closely where so many n-grams in a row sum up to this.
SPOT, SPOT_SUM = 3, 5.0
#: A window is positive where its mean is; a piece is residue where so much of it is covered and its mean reaches LEAST.
WINDOW, COVERAGE, LEAST = 9, 0.4, 0.15
#: What is learned has to reach this.
LEARN_LEAST = 0.3
#: A single word has to reach this, as headings are single words.
WORD_LEAST = 1.5
CHUNK_CHARS = 1_000_000
#: Wordings are counted by so many characters at a time, which a core's cache holds.
COUNT_CHARS = 300_000
#: Texts drawn of each seed line, if it has so many.
EXPANSIONS = 40
#: Nothing is sampled: this has no effect and stands for a test that sets it.
SAMPLE_DOCS = 10_000
#: All wordings that at least LEAST_COPIES documents show are learned. Where they are more than LEARNED they weigh as much as that
#: many, so that the seeds aren't drowned.
LEARNED, LEAST_COPIES = 2_000, 2
#: The kinds whose found wordings are learned. The others are words, marks and values with models that hold all of them.
LEARNING = ("service", "script", "filler", "prompt")
#: Counts of prose are in parts of one, so that copies share them.
WHOLE = 1 << 24
#: Fewer n-grams of different wordings than this say too little of what is rare in prose; the rest is taken as n-grams of no seed.
LEAST_PROSE = 300_000

# Seed texts: a grammar of what sites, forms and drafts usually say, written from general knowledge of such messages and with
# earlier seeds in view, some of which stand in the test documents (see the README for how many). One line is one wording; {a|b} stands for either, and EXPANSIONS of a line's texts are drawn for training.
SERVICE_SEEDS = """
{Page|Document|File|Record|Resource|Publication|Item|Entry} {not found|cannot be found|could not be found|does not exist|not available|is unavailable}
{404|HTTP 404|Error 404|HTTP/1.1 404|Status 404} {|- |: }{Page not found|Not found|File not found|Document not found}
{500|HTTP 500|Error 500|HTTP/1.1 500|Status 500} {|- |: }{Internal server error|Internal error|Server error}
{502|HTTP 502|Error 502|HTTP/1.1 502} {|- |: }{Bad gateway|Proxy error}
{503|HTTP 503|Error 503|HTTP/1.1 503} {|- |: }Service {unavailable|temporarily unavailable}
{504|HTTP 504|Error 504|HTTP/1.1 504} {|- |: }{Gateway timeout|Gateway time-out|Timed out}
{403|HTTP 403|Error 403|HTTP/1.1 403} {|- |: }{Forbidden|Access denied|Access forbidden}
{401|HTTP 401|Error 401|HTTP/1.1 401} {|- |: }{Unauthorized|Authorization required|Login required}
{429|HTTP 429|Error 429|HTTP/1.1 429} {|- |: }{Too many requests|Rate limit exceeded}
{400|HTTP 400|Error 400|408|410|HTTP/1.1 410} {|- |: }{Bad request|Request timeout|Gone}
The {requested|selected|specified} {page|document|resource|file|URL|publication|record} {was not found|could not be found|could not be located|does not exist|is not available|is no longer available|has been removed|cannot be displayed} {on this server|on our server|on our system|at this address|here}.
The {page|document|file|record|publication|resource|article|item} you {requested|are looking for|were looking for|asked for|tried to open|wanted|have requested} {could not be found|could not be located|cannot be found|does not exist|has been moved or deleted|is temporarily unavailable|could not be opened|no longer exists} {on this server|on our server|in our system|here|at the moment}.
{It|The page|The document} {may|might} have been {moved|deleted|removed|renamed} or the {link|address|URL} {may be|is} {broken|out of date|outdated|wrong|incorrect|expired}.
Please check the {address|URL|link|spelling} and try again.
No {document|page|record|entry|result|publication|file} {matches|was found for|corresponds to|exists for} {your request|your query|the given number|this number|this address|the address entered}.
{Oops!|Sorry,|We're sorry,|We are sorry,|Whoops!|Unfortunately,} {something went wrong|that page does not exist|this page cannot be displayed|an error occurred|we could not find that page|this document is not available|that did not work|this record cannot be shown}.
Something went wrong{| while loading this page| while opening the document| while displaying the text| while showing the record| on our side}.
{That didn't work|That did not work|It did not work}. {Try again|Please try again}{| later}.
An {unexpected|internal|unknown|application} error {has occurred|occurred|was encountered}{| while processing your request| while loading the document| while displaying this page}.
{Internal error|Internal server error|Application error|Server error|Database error}
Your {session|login} {has expired|has ended|has timed out|is no longer valid|timed out}{.|}
{Please|You must|You need to} {sign in|log in|log on} {again|} to {continue|view this page|access this document|proceed|see the full text}.
{Sign in|Log in} {again |}to {continue|read more|see the full text|continue reading|resume}.
Please {sign in|log in} {again|to continue|with your account|once more}.
{Access denied|Access forbidden|Permission denied|Not authorized|Unauthorized access|Access to this page is forbidden}
You {do not have permission|are not authorized|are not allowed|do not have access|don't have permission} to {view|access|open|read|see|display} this {page|document|resource|record|file|publication}.
{Access to this|This} {document|page|resource|record} is {restricted|restricted to subscribers|forbidden|limited to registered users}.
{Too many requests|Rate limit exceeded|Request limit reached|Quota exceeded|Download limit reached}{.|}
You have {reached|exceeded|used up} your {daily|monthly|download|hourly} {limit|quota|allowance}{| of downloads| for today}.
Your {download|daily|request|monthly} {quota|limit|allowance} {|for today |for this month }{is used up|has been exceeded|has been reached|is exhausted}{.|; please wait.|; wait before you ask for more.}
{The service|This service|The server|The site|The system|The website|The database|Our server|The archive|The viewer} is {temporarily unavailable|currently unavailable|down for maintenance|undergoing maintenance|under maintenance|overloaded|busy|offline|not available at the moment|not responding}.
{Service|Server|Site} {unavailable|temporarily unavailable|is busy|under maintenance}
{Please|You may|You can} {try again|come back|retry|return} {later|in a few minutes|in a moment|shortly|tomorrow|after some time}.
Please {try|come back} again later.
{Scheduled|Planned} maintenance {in progress|is under way}. We will be back {soon|shortly}.
The {upstream|remote|backend|origin} {server|service|system} {sent|returned|gave} an {invalid|empty|unexpected} {response|reply|answer}.
The {server|request|connection|gateway|service|database|archive|operation} {timed out|has timed out|took too long to respond|did not respond in time|is taking too long to respond}.
{Request|Connection|Gateway|Session} {timed out|timeout|time-out}
{Bad gateway|Bad request|Gateway timeout|Service unavailable|Forbidden|Unauthorized|Not found}
{Reload|Refresh} the page {and try again|to retry|or go back}.
Contact the administrator if the {problem|error} persists.
{Seite|Dokument|Datei|Schrift|Eintrag} {nicht gefunden|nicht vorhanden|nicht verfügbar|existiert nicht}
{Die angeforderte|Die gewünschte|Die gesuchte} {Seite|Datei|Schrift} {wurde nicht gefunden|existiert nicht|konnte nicht gefunden werden|ist nicht verfügbar|ist auf diesem Server nicht vorhanden}.
{Das angeforderte|Das gewünschte|Das gesuchte} {Dokument|Objekt} {wurde nicht gefunden|existiert nicht|konnte nicht gefunden werden|ist auf diesem Server nicht vorhanden|kann nicht angezeigt werden}.
{Ihre|Die} {Sitzung|Anmeldung} ist {abgelaufen|beendet|nicht mehr gültig}{.|}
Bitte {melden Sie sich|loggen Sie sich} {erneut|neu|wieder|noch einmal} {an|ein}{| , um fortzufahren}.
{Zugriff verweigert|Zugang verweigert|Kein Zugriff|Keine Berechtigung|Zugriff nicht erlaubt}
Sie {haben keine Berechtigung|sind nicht berechtigt}, {diese Seite|dieses Dokument|diese Datei|diese Schrift} {anzusehen|anzuzeigen|zu öffnen|aufzurufen|einzusehen}.
{Dienst|Server|Seite} {vorübergehend|derzeit|zurzeit|momentan} nicht {verfügbar|erreichbar}
{Der Dienst|Der Server|Die Seite|Das System|Die Datenbank} {ist vorübergehend nicht verfügbar|ist derzeit nicht erreichbar|wird gewartet|wird gerade gewartet|ist überlastet}.
Bitte {versuchen Sie es|probieren Sie es} {später|in einigen Minuten|morgen} {erneut|noch einmal|wieder}.
{Zu viele Anfragen|Zu viele Zugriffe|Anfragelimit erreicht|Kontingent erschöpft}{.|}
Ihr {Kontingent|Limit|Tageskontingent} {für heute |}ist {aufgebraucht|erschöpft|erreicht|überschritten}.
{Interner Fehler|Interner Serverfehler|Unerwarteter Fehler|Serverfehler}
{Beim Laden|Beim Anzeigen|Beim Öffnen|Bei der Anzeige} {der Seite|des Dokuments|des Textes} ist ein Fehler aufgetreten.
Ein {unerwarteter|interner} Fehler ist aufgetreten.
{Die Anfrage|Die Verbindung|Der Server} {hat zu lange gedauert|hat zu lange gebraucht|hat nicht rechtzeitig geantwortet}.
{Page|Document|Fichier|Ressource} {introuvable|non trouvé|non trouvée|inexistant|indisponible}
{La page demandée|La page recherchée} {est introuvable|n'existe pas|n'a pas été trouvée|n'est pas disponible}{| sur ce serveur}.
Le {document|fichier} {demandé|recherché} {est introuvable|n'existe pas|n'a pas été trouvé|ne peut pas être affiché}{| sur ce serveur}.
Votre session {a expiré|est terminée|n'est plus valide}{.|}
{Veuillez vous|Merci de vous} {reconnecter|identifier|connecter}{| à nouveau| pour continuer}.
{Reconnectez-vous|Connectez-vous|Identifiez-vous} pour {continuer|poursuivre|lire la suite|poursuivre la lecture}.
{Accès refusé|Accès interdit|Accès non autorisé|Autorisation refusée}
Vous n'{êtes pas autorisé|avez pas le droit|avez pas la permission} {à|de} {consulter|afficher|voir|ouvrir} {ce document|cette page|ce fichier}.
{Service|Serveur|Site} {momentanément|temporairement|actuellement} {indisponible|inaccessible}
{Le service|Le serveur|Le site|Le système} est {en maintenance|en cours de maintenance|temporairement indisponible|surchargé|actuellement indisponible}.
Veuillez {réessayer|essayer à nouveau|revenir} {plus tard|dans quelques minutes|ultérieurement}.
{Trop de requêtes|Trop de demandes|Limite de requêtes atteinte|Quota dépassé}{.|}
Votre {quota|limite} de {téléchargement|consultation|requêtes} est {épuisé|atteinte|dépassé|atteint}.
{Erreur interne|Erreur interne du serveur|Erreur inattendue|Erreur du serveur}
Une erreur {s'est produite|est survenue} {lors de l'affichage|lors du chargement|pendant l'ouverture} {de la page|du document|du texte}.
{La requête|La demande|Le serveur} {a pris trop de temps|a expiré|n'a pas répondu à temps}.
{Página|Documento|Archivo|Recurso} no {encontrada|encontrado|disponible|existe}
{La página solicitada|La página buscada} {no existe|no se ha encontrado|no está disponible|no se encuentra}{| en este servidor}.
El {documento|archivo} {solicitado|buscado} {no existe|no se ha encontrado|no está disponible|no se puede mostrar}{| en este servidor}.
{Su|La} sesión {ha caducado|ha expirado|ha terminado|ya no es válida}{.|}
{Inicie sesión|Identifíquese|Vuelva a iniciar sesión} {de nuevo|otra vez|para continuar|para seguir leyendo}.
{Acceso denegado|Acceso prohibido|Acceso no autorizado|Permiso denegado}
{No tiene permiso|No está autorizado|Usted no tiene permiso} para {ver|consultar|abrir|mostrar} {este documento|esta página|este archivo}.
{Servicio|Servidor|Sitio} {no disponible temporalmente|temporalmente no disponible|fuera de servicio|no disponible}
{El servicio|El servidor|El sitio|El sistema} {está en mantenimiento|no está disponible|está sobrecargado|se encuentra en mantenimiento}.
{Inténtelo de nuevo|Vuelva a intentarlo|Pruebe de nuevo} {más tarde|en unos minutos|mañana}.
{Demasiadas solicitudes|Demasiadas peticiones|Límite de solicitudes alcanzado|Cuota superada}{.|}
{Ha agotado su|Se ha agotado su|Ha superado su} {cuota|límite} de {descargas|descarga|consultas}.
{Error interno|Error interno del servidor|Error inesperado|Error del servidor}
{Se produjo|Se ha producido|Ha ocurrido} un {error|fallo} al {mostrar|cargar|abrir} {la página|el documento|el texto}.
{La solicitud|La petición|El servidor} {ha tardado demasiado|tardó demasiado|no respondió a tiempo}.
{页面|网页|文档|文件|记录}{不存在|未找到|找不到|无法找到}
{您|你}{请求|访问|查找}的{页面|文档|文件|文献|内容}{不存在|无法找到|未找到|已被删除|无法显示}。
{会话|登录|您的会话}{已过期|已超时|已结束|已失效}
请{重新登录|再次登录|登录后继续|登录后再试}。
{访问被拒绝|拒绝访问|禁止访问|没有权限|无权访问}
{您|你}{没有|无}权限{查看|访问|打开|浏览}{本|此|该}{页面|文档|文件|文献}。
{服务|系统|服务器|网站}{暂时不可用|暂不可用|正在维护|维护中|繁忙}
{系统|服务器|网站}{正在维护|维护中|繁忙|升级中}，请稍后{再试|重试|访问}。
{请求过多|请求次数过多|访问过于频繁|超出限额}
{您的|今日|当日}{下载|访问|请求}{额度|配额|次数}已{用完|用尽|达上限}。
{内部错误|服务器内部错误|系统错误|未知错误}
{加载|显示|打开}{页面|文档|全文|内容}时{出错|发生错误|出现错误}。
{请求|连接|服务器响应}{超时|时间过长}，请稍后{再试|重试}。
"""
SCRIPT_SEEDS = """
{JavaScript|Scripting|Script support} is {required|disabled|turned off|not enabled|needed|switched off}{.| in your browser.| to view this page.| to use this site.| to continue.}
{Please enable|You need to enable|You must enable|Enable|Please turn on|Please activate|Kindly enable|Switch on|Please allow} {JavaScript|scripts|scripting|active scripting|JavaScript in your browser|JavaScript and cookies} {to continue|to view this page|to view this document|to use this site|to read the full text|and reload the page|and refresh the page|and try again|in your browser settings|to see this content|to display the document}.
You need to {enable|allow|turn on|activate} {it|them|JavaScript} to {use|view|see|open} {this site|this page|the viewer|the document|the application}.
This {site|page|application|viewer|website|reader|service|document} {requires|needs|relies on} {JavaScript|scripts|scripting|JavaScript to be enabled|scripts to be allowed|scripting to be turned on|a browser with JavaScript}.
Your {browser|web browser|client|device} {does not support|has disabled|blocks|does not run|is blocking|cannot run} {JavaScript|scripts|scripting}{.|, so this page cannot be shown.|, so the document cannot be displayed.|, so the content cannot be loaded here.|, therefore the text cannot be shown.}
{Checking|Verifying} your {browser|connection|web browser} before {accessing|opening|loading|showing} {the site|this page|the document|the website|the viewer}...
{Scripts|JavaScript|Cookies} and {cookies|scripts|JavaScript} must be {enabled|allowed|turned on|accepted|permitted} {to continue|to proceed|to go on|for this page|to view this page}.
Change {the settings of your browser|your browser settings|the browser's settings} and {reload|refresh|try again}{.| the page.}
To {view|read|see|use|open} {this page|the full text|this document|the text|the description}, {enable|turn on|switch on|activate|allow} {JavaScript|scripting|active scripting|scripts} and {reload|refresh} the page.
<noscript>{JavaScript is required|Please enable JavaScript|This page needs scripts}.</noscript>
Bitte {aktivieren|erlauben|schalten} Sie {JavaScript|Skripte}{, um diese Seite anzuzeigen.|, um dieses Dokument anzuzeigen.|, um fortzufahren.| in Ihrem Browser.}
{Für die Anzeige|Zur Anzeige|Zum Lesen} {dieser Seite|des Dokuments|des Textes|des Volltextes} {müssen Skripte|muss JavaScript} {im Browser |}{erlaubt|aktiviert|eingeschaltet} {sein|werden}.
{JavaScript ist|Skripte sind} {deaktiviert|erforderlich|ausgeschaltet|nicht aktiviert}.
Ihr Browser {unterstützt kein JavaScript|führt keine Skripte aus|blockiert Skripte}.
Veuillez {activer|autoriser} {JavaScript|les scripts}{ pour afficher cette page.| pour afficher ce document.| pour continuer.| dans votre navigateur.}
{Cette page|Ce site|L'affichage du document|L'affichage du texte} {exige|nécessite|requiert} {JavaScript|que JavaScript soit activé|que les scripts soient autorisés|que les scripts soient activés}.
{JavaScript est|Les scripts sont} {désactivé|désactivés|requis|nécessaire}.
Votre navigateur {ne prend pas en charge JavaScript|n'exécute pas les scripts|bloque les scripts}.
{Active|Habilite|Por favor, active|Por favor, habilite} {JavaScript|los scripts} para {ver esta página|ver este documento|continuar|mostrar el texto}.
{Esta página|Este sitio|Este visor} {requiere|necesita|exige} {JavaScript|que JavaScript esté activado|que se permitan scripts|que su navegador permita ejecutar scripts}.
{JavaScript está|Los scripts están} {desactivado|desactivados|deshabilitado}.
Su navegador {no admite JavaScript|no ejecuta scripts|bloquea los scripts}.
请{启用|开启|打开|允许}{JavaScript|脚本|脚本功能}{以查看本页|以查看本文档|后重试|以继续}。
{您的|你的}浏览器{未启用|不支持|未开启|已禁用}{JavaScript|脚本|脚本功能}{，无法显示本页|，无法显示全文|，无法显示内容}。
{本页面|本网站|此页面}需要{JavaScript|脚本|启用JavaScript}{才能|方可}{显示|使用|浏览}。
"""
FILLER_SEEDS = """
Your {text|title|content|description} {goes here|here|comes here}.
{Insert|Enter|Type|Add|Put|Write} {your|the|some} {text|content|title|description|summary} here.
{Placeholder|Dummy|Sample|Example|Filler} {text|content|paragraph}{, to be replaced.|, do not use.| only.|.}
This {text|paragraph|section|passage} {is|serves as|is only} {a placeholder|placeholder text|filler text|dummy text}{.| and will be replaced later.| and will be removed before publication.| to be replaced by the final text.}
This {paragraph|text|section} only {fills the space|fills space|fills the page} and will be {replaced|exchanged} by the {final|real|actual} {text|content|wording}.
{Example|Sample|Placeholder|Dummy} {content|text|paragraph}, to be {replaced|exchanged|changed|removed} before {publication|printing|submission|filing}.
Click {here|or tap here} to {enter|add|insert|edit|type} {text|a title|your text}.
TODO{: |, | - | }{add|write|insert|complete|fill in|finish} {text|claims|the claims|description|drawings|abstract|this section|the summary}
{|???|(|[}{to be|To be} {completed|determined|added|announced|supplied|filled in|provided|written}{| by the drafter| by the author| by the applicant| later| before filing}{|???|)|]}
({abstract|description|summary|drawings|claims|text|title} {to follow|follows|to come|missing|to be added|to be supplied})
({put|insert|add|write} {|the }{background|summary|description|claims|abstract|text} {|section }here)
{Hier steht|Hier folgt|Hier kommt} {Ihr|der|Ihre} {Text|Beschreibung|Inhalt}.
{Dieser Absatz|Dieser Text|Dieser Abschnitt} {dient nur als Platzhalter|ist nur ein Platzhalter|füllt nur den Platz}{.| und wird später ersetzt.| und wird durch den endgültigen Text ersetzt.}
{Beispieltext|Mustertext|Platzhaltertext}, wird {noch|später} {ersetzt|ausgetauscht}.
({Zusammenfassung|Beschreibung|Ansprüche|Text|Zeichnungen} {folgt|folgen|fehlt noch|wird nachgereicht})
Klicken Sie hier, um {Text|einen Titel} einzugeben.
{Votre texte|Votre titre|Votre contenu} {ici|vient ici}.
Ce {paragraphe|texte} {ne sert qu'à remplir l'espace|sert de texte de remplissage|est provisoire} et sera remplacé {plus tard|par le texte définitif|par la version définitive}.
{Texte d'exemple|Texte provisoire|Texte fictif}, à {remplacer|modifier|supprimer} avant {publication|le dépôt|impression}.
Cliquez ici pour {entrer|ajouter|saisir} {du texte|un titre|votre texte}.
({résumé|abrégé|description|dessins|revendications} à {suivre|venir|compléter})
{Su texto|Su título|Su contenido} {aquí|va aquí}.
Este {párrafo|texto} {solo ocupa el espacio|sirve de relleno|es provisional} y {será sustituido|se sustituirá|será reemplazado} {más tarde|por el texto definitivo|por la versión definitiva}.
{Texto de ejemplo|Texto provisional|Texto de relleno}, que se {sustituirá|cambiará|eliminará} antes de la {publicación|presentación|impresión}.
Haga clic aquí para {escribir|introducir|añadir} {texto|un título|su texto}.
({resumen|descripción|dibujos|reivindicaciones} {pendiente|pendientes|por añadir|a continuación})
{此处|这里|在此}{为|输入|填写|添加}{示例文字|占位文字|正文|您的文字|内容}。
{本段|本文|此段文字}仅{用于占位|为占位文字|作示例}，{稍后|以后|提交前}将{替换|更换|删除}{|为正式内容|为最终内容}。
{单击|点击}此处{输入|添加|编辑}{文字|标题|内容}。
"""
LOREM_SEEDS = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
"""
#: Instructions in place of a value; they stand in brackets of any kind.
PROMPT_SEEDS = """
{insert|enter|type|add|fill in|state|describe} {|the |your }{title|summary|description|abstract|claims|name|date|text|address|number|background|field} {|of the invention |of the drawings |of the applicant |of the device }here
{insert|enter|add} {here|text|title|name|date|number}
{TITLE|NAME|DATE|ADDRESS|NUMBER|DESCRIPTION} OF {THE INVENTION|INVENTION|APPLICANT|THE APPLICANT|INVENTOR|FILING}
{Applicant|Inventor|Attorney|Client|Company|Your} {name|address|number}
describe {the invention|the drawings|the figures|the background|the embodiments}{| here}
{Titel|Name|Beschreibung|Zusammenfassung|Datum} {der Erfindung|des Anmelders|der Zeichnungen|hier} {einfügen|eintragen|eingeben|ergänzen}
{Titel|Beschreibung|Zusammenfassung|Text} hier {einfügen|eintragen|eingeben}
{insérer|saisir|décrire|indiquer} {le titre|le résumé|la description|le nom|les dessins} {|de l'invention |du demandeur }{ici|}
{insertar|escribir|describir|indicar} {el título|el resumen|la descripción|el nombre|los dibujos} {|de la invención |del solicitante }{aquí|}
{insertar|describir} aquí {el título|los dibujos|el resumen}
{在此|此处|请在此}{输入|填写|插入}{标题|摘要|说明书|发明名称|申请人名称|日期|正文}
"""
#: Some prose of the same languages, so that the words of any sentence are known to be prose however small the tables are.
PROSE_SEEDS = """
While the first part is being moved, the second part is held in its place by a spring, and the process is repeated until the end is reached.
The system sends a request to the server, and when an answer is received, the client stores the value and shows it to the user on the screen.
If an error occurs, the controller repeats the operation or logs the event, so that the cause can be found later by the person in charge.
When a page is requested, the server checks whether the user has the permission to see it and, if this is not the case, answers with a status.
The message is displayed on a terminal which is connected to the network, and it may be switched off by means of a key.
In a preferred embodiment, the text is replaced by another text before printing, and the template is filled with the values of the table.
It has been found that only a few steps are necessary for this purpose, which is an advantage over known methods and devices of this kind.
The browser runs a script that is loaded from the site; where scripts are turned off, the gateway delivers a static page instead.
As described above, the document may have been changed before it is read again, so the record contains the time of the last change.
The unit is not required to be available at all times, because its data are kept in a store until the service has been restarted.
The session of the user ends after a given time without any input, and the access is then limited by the token that was issued.
According to the invention, the number of requests in a unit of time is counted, and further requests wait until the count falls below a limit.
Während das erste Teil bewegt wird, hält eine Feder das zweite Teil an seinem Platz, und der Vorgang wird wiederholt, bis das Ende erreicht ist.
Das Gerät sendet eine Anfrage an den Server, und sobald eine Antwort vorliegt, wird der Wert gespeichert und dem Benutzer auf der Anzeige gezeigt.
Wenn ein Fehler auftritt, so wiederholt die Steuerung den Vorgang oder meldet das Ereignis, damit die Ursache später gefunden werden kann.
Die Seite wird nur dann angezeigt, wenn der Benutzer die Berechtigung dazu hat und die Sitzung noch nicht beendet ist.
Der Text dient in der Vorlage als Beispiel und wird vor dem Druck durch die Werte der Tabelle ersetzt.
Im Browser wird ein Skript ausgeführt, das von dem Dienst geladen wird; ist dies nicht möglich, so liefert das Gerät eine feste Seite.
Pendant que la première pièce est déplacée, un ressort maintient la seconde pièce à sa place, et l'opération est répétée jusqu'à la fin.
Le dispositif envoie une requête au serveur et, dès qu'une réponse est reçue, la valeur est enregistrée et présentée à l'utilisateur sur l'écran.
Lorsqu'une erreur se produit, la commande répète l'opération ou enregistre l'événement afin que la cause puisse être trouvée plus tard.
La page n'est affichée que si l'utilisateur a le droit de la consulter et si la session n'est pas encore terminée.
Le texte du gabarit sert d'exemple et il est remplacé par les valeurs du tableau avant l'impression.
Lorsque les scripts sont désactivés dans le navigateur, la passerelle fournit une page fixe au lieu du document.
Mientras se mueve la primera pieza, un muelle mantiene la segunda pieza en su lugar, y la operación se repite hasta que se alcanza el final.
El dispositivo envía una solicitud al servidor y, cuando se recibe una respuesta, el valor se guarda y se muestra al usuario en la pantalla.
Si se produce un error, el control repite la operación o registra el suceso, para que la causa se pueda encontrar más tarde.
La página solo se muestra si el usuario tiene permiso para verla y si la sesión no ha terminado todavía.
El texto de la plantilla sirve de ejemplo y se sustituye por los valores de la tabla antes de la impresión.
Si los scripts están desactivados en el navegador, la pasarela entrega una página fija en lugar del documento.
当第一部件移动时，弹簧将第二部件保持在其位置，重复该过程直到结束。
该装置向服务器发送请求，收到响应后将数值存储并在屏幕上显示给用户。
如果发生错误，控制单元重复该操作或记录该事件，以便以后可以找到原因。
只有当用户具有查看权限且会话尚未结束时，才显示该页面。
模板中的文字用作示例，在打印之前由表中的数值替换。
当浏览器中的脚本被关闭时，网关提供静态页面代替文档。
"""
#: How often the text above counts.
PROSE_WEIGHT = 3

# Names that fields of patent templates have, ways of marking a field, and what programs write for no value.
FIELD_NAMES = ["invention_title", "abstract_text", "applicant.name", "description.par", "filing_date", "priority_no", "pub_no", "ipc_main", "inventor_1", "drawing_list", "claimbody", "technicalfield", "title", "name"]
FIELD_MARKS = ["{{%s}}", "{{ %s }}", "{%s}", "<<%s>>", "«%s»", "%%%%%s%%%%", "@@%s@@", "__%s__", "[[%s]]", "$%s$", "#%s#", "${%s}", "<%%= %s %%>", "{%% block %s %%}", "<?php echo $%s; ?>", "[%%%s%%]"]
PROMPT_MARKS = ["[%s]", "<%s>", "(%s)", "［%s］", "【%s】", "{%s}"]
EMPTY_VALUES = ["undefined", "null", "NaN", "None", "[object Object]", "N/A", "#REF!", "nil"]

_NAME = r"[^\W\d][\w.\-]*"
#: A piece that is one open field as a whole.
OPEN_FIELD = re.compile(
    rf"\{{\{{\s*{_NAME}\s*\}}\}}|\{{{_NAME}\}}|<<\s*{_NAME}\s*>>|«\s*{_NAME}\s*»|%%\s*{_NAME}\s*%%|@@\s*{_NAME}\s*@@|__{_NAME}__|\[\[\s*{_NAME}\s*\]\]|\$\{{\s*{_NAME}\s*\}}|\${_NAME}\$|#{_NAME}#"
    rf"|<%=?\s*{_NAME}\s*%>|\{{%\s*[\w ]*{_NAME}\s*%\}}|<\?(?:php|=)[^?]*\?>|\[%\s*{_NAME}\s*%\]",
    re.IGNORECASE,
)
#: Marks that mean a field and hardly anything else, so that one may stand within a sentence.
_LETTERED = r"[^\W\d_][\w.\-]*"
MARKED = re.compile(
    rf"[{{<%@$\[](?<![A-Za-z0-9_}}\^].)(?:(?<=\{{)(?:\{{[ \t]*{_LETTERED}[ \t]*\}}\}}|%[ \t]*(?:[a-z]+[ \t]+)?{_LETTERED}[ \t]*%\}})|(?<=<)(?:<[ \t]*{_LETTERED}[ \t]*>>|%=?[ \t]*{_LETTERED}[ \t]*%>|\?(?:php|=)[^?\n]{{1,200}}\?>)"
    rf"|(?<=%)%[ \t]*{_LETTERED}[ \t]*%%|(?<=@)@[ \t]*{_LETTERED}[ \t]*@@|(?<=\$)\{{[ \t]*{_LETTERED}[ \t]*\}}|(?<=\[)%[ \t]*{_LETTERED}[ \t]*%\])(?![A-Za-z0-9_{{^])"
)
_DOUBLE = ("{{", "{%", "<<", "<%", "<?", "%%", "@@", "${", "[%")
#: The marks of those.
PLAIN_MARKS = ["{{%s}}", "{{ %s }}", "<<%s>>", "<< %s >>", "%%%%%s%%%%", "@@%s@@", "${%s}", "<%%= %s %%>", "<%% %s %%>", "{%% %s %%}", "{%% block %s %%}", "<?php echo $%s; ?>", "<?= $%s ?>", "[%%%s%%]", "[%% %s %%]"]
#: A sentence with these words treats fields instead of having one left open.
_TREATS = re.compile(
    r"\b(?:such as|of the form|of the kind|fields|tags?|variables?|placeholders?|macros?|tokens?|templates?|strings?|brackets?|syntax|expression|expand\w*|replac\w*|substitut\w*|pars\w+|written|print(?:s|ed|ing)|escap\w*"
    r"|felder|feldern|platzhalter\w*|variablen?|ersetz\w*|vorlagen?|zeichenfolge\w*|der form|champs|balises?|remplac\w*|gabarit\w*|de la forme|tels? que|campos|etiquetas?|sustitu\w*|reemplaz\w*|plantillas?|de la forma|tales como)\b"
    r"|字段|变量|占位|标签|替换|模板|形如|例如|字符串",
    re.IGNORECASE,
)
_FORMULA = re.compile(r"[\\=^{}$√∫·+*<>|#]")
_QUOTES = (("“", "”"), ("„", "“"), ("«", "»"), ("「", "」"), ("‘", "’"))
_PROMPT = re.compile(r"[\[［【<({](.+)[\]］】>)}]", re.DOTALL)
_EMPTY = re.compile("|".join(re.escape(v) for v in EMPTY_VALUES), re.IGNORECASE)
#: A message has two words, or four characters of a script without spaces.
_SAYS = re.compile(r"\w[^\w]*\s[^\w]*\w|[\u3040-\u9fff\uac00-\ud7af]{4}")
_LETTERS = re.compile(r"\w{2}")
#: Names of a patent's parts. They repeat as notices do, so how often they occur can't tell them from those.
_PART = (
    r"abstract|summary|descriptions?|detailed|brief|background|claims?|drawings?|figures?|inventions?|disclosure|embodiments?|technical|field|title"
    r"|zusammenfassung|beschreibung|kurze|ausführliche|detaillierte|zeichnung(?:en)?|figuren|erfindung|patentansprüche|ansprüche|titel|gebiet"
    r"|abrégé|résumé|détaillée|brève|revendications?|dessins?|titre|domaine|resumen|descripción|detallada|breve|reivindicaci(?:ón|ones)|dibujos?|título|campo"
    r"|摘要|说明书|权利要求书?|具体实施方式|技术领域|背景技术|附图说明|发明内容"
)
_HEADING = re.compile(rf"[\W\d]*(?:{_PART})(?:[\W\d]+(?:{_PART}|of|the|and|der|die|des|und|de|du|la|las|los|les|et|y|l|d))*[\W\d]*", re.IGNORECASE)
#: Marks of paragraphs and claims, and quotes' ends, are not part of a piece.
_MARK = re.compile(r"^(?:[\[(]?\d{1,5}[\])]?[.)]?(?:\s+-)?\s+|\[\d{4}\]|</?noscript>\s*|\(\d+\)\s*)+")
#: Where one piece ends and the next begins: sentences, cut-off sentences, fields and headings.
_BREAK = re.compile(r"\s(?:(?<=[.!?]\s)\s*|\.\.\.\s|(?<=:\s)\s*|\s+|[|>]\s)|</?(?:noscript|h\d|p|div)>")
_WIDE_BREAK = re.compile(rf"(?<=[。！？])|{_BREAK.pattern}")

PROSE = "prose"
KINDS = ("service", "script", "filler", "lorem", "mash", "prompt", "field", "empty")


def _lines(seeds: str) -> list[str]:
    return [line for line in seeds.split("\n") if line]


def _spread(line: str, rng: np.random.Generator) -> list[str]:
    """Texts of a seed line: all of them, or EXPANSIONS draws of its alternatives."""
    parts = re.split(r"\{([^{}]*)\}", line)
    choices = [p.split("|") if i % 2 else [p] for i, p in enumerate(parts)]
    n = int(np.prod([len(c) for c in choices]))
    picks = range(n) if n <= EXPANSIONS else sorted(set(rng.integers(0, n, EXPANSIONS).tolist()))
    out = []
    for pick in picks:
        text = ""
        for c in choices:
            pick, at = divmod(pick, len(c))
            text += c[at]
        out.append(" ".join(text.split()))
    return list(dict.fromkeys(out))


def seed_lines() -> dict[str, list[str]]:
    """The lines of each kind that has a grammar."""
    return {k: _lines(s) for k, s in (("service", SERVICE_SEEDS), ("script", SCRIPT_SEEDS), ("filler", FILLER_SEEDS), ("lorem", LOREM_SEEDS), ("prompt", PROMPT_SEEDS))}


def seed_texts(given: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """The training texts of each kind, of all seed lines or those given."""
    rng = np.random.default_rng(7)
    lines = {k: [x for line in some for x in _spread(line, rng)] for k, some in (given or seed_lines()).items()}
    words = re.findall(r"[a-z]+", LOREM_SEEDS.lower())
    # filler is the words in any order
    lines["lorem"] += [" ".join(some).capitalize() + "." for some in rng.choice(words, (1500, 12)).tolist()]
    lines["lorem"] += [", ".join(" ".join(some[i : i + 3]) for i in (0, 3, 6)) for some in rng.choice(words, (300, 9)).tolist()]
    # short words, repeated as their n-grams are few
    lines["filler"] += ["TBD", "TBA", "TBC", "TODO", "FIXME", *("X" * n for n in range(3, 9))] * 10
    lines["filler"] += [" ".join([w] * n) for w in ("bla", "blah", "text", "test", "foo bar", "dummy text", "sample text", "filler text", "placeholder text", "Blindtext", "Mustertext", "texte", "texto") for n in (8, 16, 32)]
    struck = ["".join(some[:n]) for some, n in zip(rng.choice(list("asdfghjkl"), (32_000, 11)).tolist(), rng.integers(3, 12, 32_000).tolist(), strict=True)]
    lines["mash"] = [" ".join(struck[i : i + 8]) for i in range(0, len(struck), 8)]
    lines["prompt"] = [m % p for m in PROMPT_MARKS for p in lines["prompt"]]
    letters = "abcdefghijklmnopqrstuvwxyz"
    # names of one and two letters and those that begin with any two, so that the marks tell and not the name
    names = [*(f"{c}{e}{rest}" for c in letters for e in letters + "_" for rest in ("", "_name"))]
    # repeated, so that they weigh as much as the many names that follow
    lines["field"] = [m % n for m in FIELD_MARKS for n in (*FIELD_NAMES, *(f"{c}field_{c}" for c in letters))] * 10
    lines["field"] += [f"{side}{m % n}{side}" for m in PLAIN_MARKS for n in [*letters] * 10 + names for side in ("", " ")]
    lines["empty"] = [f"{p}{v}" for v in EMPTY_VALUES for p in ("", "value: ")]
    return lines


@cache
def _folding() -> np.ndarray:
    """By character its fold. No character beyond the first 2 planes has a case."""
    to = np.arange(0x110000, dtype=np.uint32)
    to[:0x20000] = [ord(low) if len(low := chr(i).lower()) == 1 else i for i in range(0x20000)]
    to[48:58] = 48
    return to


def fold(text: str) -> np.ndarray:
    """The characters of a text as numbers: lower case, digits alike. As many as the text has."""
    return _folding()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def slots(codes: np.ndarray) -> np.ndarray:
    """The slot of the n-gram that starts at each character."""
    if len(codes) < ORDER:
        return np.zeros(0, np.uint32)
    h = codes[: 1 - ORDER] * np.uint32(0x9E3779B1)
    for i, factor in enumerate((0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F), 1):
        h += codes[i : len(codes) - ORDER + 1 + i] * np.uint32(factor)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - SLOT_BITS)


def _inner(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of texts with how often they occur, without those that reach from one text into the next, and the wordings' fingerprints."""
    codes = fold("\n" + "\n".join(texts) + "\n")
    grams = slots(codes)
    own, n = np.unique(grams[(codes[1 : 1 + len(grams)] != 10) & (codes[2 : 2 + len(grams)] != 10)], return_counts=True)
    return own, n, _wordings(codes, grams)[1]


@dataclass
class Learned:
    """What all learned wordings come to: by kind their n-grams and how often those occur, the wordings' number and fingerprints."""

    grams: dict[str, tuple[np.ndarray, np.ndarray]]
    wordings: int
    prints: np.ndarray

    @classmethod
    def of(cls, wordings: DataFrame) -> Learned:
        """Of the rows (kind, piece), each once; they are counted where they are."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                by: dict[str, list[str]] = {}
                for kind, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    by.setdefault(kind, []).append(piece)
                for kind, some in by.items():
                    own, n, prints = _inner(some)
                    prints = np.unique(prints)
                    at = pa.array([LEARNING.index(kind)] * len(own) + [-1] * len(prints), pa.int32())
                    yield pa.RecordBatch.from_arrays([at, pa.array(np.concatenate([own.astype(np.int64), prints])), pa.array(np.concatenate([n.astype(np.int64), np.zeros(len(prints), np.int64)]))], ["kind", "item", "n"])

        # a row for each kind and slot, at most 1 << SLOT_BITS a kind, and 8 bytes for each wording
        rows = wordings.select("kind", "piece").mapInArrow(count, "kind int, item bigint, n bigint").groupBy("kind", "item").agg(F.sum("n").alias("n")).toArrow()
        kind, item, n = (rows[c].to_numpy() for c in ("kind", "item", "n"))
        return cls({k: (item[kind == i], n[kind == i]) for i, k in enumerate(LEARNING) if (kind == i).any()}, wordings.count(), item[kind < 0])


@dataclass
class Seeds:
    """The n-grams of the seeds: ``place`` maps a slot to its number (the last for all others), ``share`` is by kind and number."""

    place: np.ndarray
    share: np.ndarray
    #: The wordings that are no prose: fingerprints of the training texts that are sentences.
    prints: np.ndarray

    @classmethod
    def fit(cls, texts: dict[str, list[str]] | None = None, learned: Learned | None = None) -> Seeds:
        """The models of the seed texts, or of other training texts by kind, and of what was learned."""
        texts = texts or seed_texts()
        by_kind, said = {}, []
        for kind, some in texts.items():
            own, n, prints = _inner(some)
            by_kind[kind] = [(own, n)]
            if kind in LEARNING:
                said.append(prints)
        if learned:
            weight = min(1.0, LEARNED / max(1, learned.wordings))
            for kind, (own, n) in learned.grams.items():
                by_kind[kind].append((own, n * weight))
            said.append(learned.prints)
        used = np.unique(np.concatenate([own for some in by_kind.values() for own, _ in some]))
        place = np.full(1 << SLOT_BITS, len(used), np.uint16 if len(used) < 1 << 16 else np.int32)
        place[used] = np.arange(len(used))
        counts = np.stack([sum(np.bincount(place[own], n, len(used)) for own, n in by_kind[k]) for k in KINDS])
        return cls(place, counts / counts.sum(axis=1, keepdims=True), np.unique(np.concatenate(said)))

    def ratios(self, prose: np.ndarray) -> np.ndarray:
        """Log likelihood ratios by kind and number, from the counts of all n-grams in prose (the last: those of no seed)."""
        natural = prose[:-1] / max(1, prose.sum()) + FLOOR
        ratio = np.clip(np.log(0.95 * self.share + 0.05 * FLOOR) - np.log(natural) - PRIOR, UNSEEN, CEILING)
        ratio[self.share == 0] = UNSEEN
        return np.hstack([ratio, np.full((len(KINDS), 1), UNSEEN)]).astype(np.float32)


def _chunks(texts: list[str], least: int | None = None) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Texts joined by line feeds, ``least`` (else CHUNK_CHARS) characters or so at a time, with the places where each begins and which text it is.

    A text longer than CHUNK_CHARS is cut at a line's end, or, where it has none, between two characters.
    """
    held, starts, whose, size = ["\n"], [], [], 1
    for i, text in enumerate(texts):
        while text:
            end = len(text)
            if end > CHUNK_CHARS:
                end = text.rfind("\n", CHUNK_CHARS // 2, CHUNK_CHARS) + 1 or CHUNK_CHARS
            part, text = text[:end], text[end:]
            starts.append(size)
            whose.append(i)
            held += [part, "\n"]
            size += len(part) + 1
            if size > (least or CHUNK_CHARS):
                yield "".join(held), np.array(starts), np.array(whose)
                held, starts, whose, size = ["\n"], [], [], 1
    if starts:
        yield "".join(held), np.array(starts), np.array(whose)


def _among(codes: np.ndarray, characters: str) -> np.ndarray:
    out = codes == ord(characters[0])
    for c in characters[1:]:
        out |= codes == ord(c)
    return out


def _wordings(codes: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of folded text that begins with a line feed, where each wording begins in it, with its fingerprint.

    A wording ends with its sentence, label or line. The fingerprint is of the characters and n-grams within, so it is
    the same wherever a wording stands and whatever its digits are. The n-grams that lead to the next are its own.
    """
    space = np.flatnonzero(codes == 32)
    wide = np.flatnonzero(codes > 0x3000)
    cut = codes == 10
    cut[space[_among(codes[space - 1], ".!?:")]] = True
    cut[wide[_among(codes[wide], "。！？")]] = True
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(codes))
    of_grams = np.zeros(1, np.uint64) if not len(grams) else grams.astype(np.uint64)
    np.cumsum(np.multiply(of_grams, of_grams, out=of_grams), out=of_grams)
    of_chars = np.cumsum(codes, dtype=np.uint64)
    low = np.minimum(begin + 1, len(grams))
    high = np.maximum(np.minimum(end - ORDER + 1, len(grams)), low)
    prints = (of_grams[np.maximum(high, 1) - 1] - of_grams[np.maximum(low, 1) - 1]) * np.uint64(0x9E3779B97F4A7C15) + (of_chars[end - 1] - of_chars[begin]) * np.uint64(0xD6E8FEB86659FD93)
    return begin, prints.view(np.int64)


def copied_wordings(documents: DataFrame) -> dict[int, int]:
    """The fingerprints of wordings with many copies in all texts, and how many.

    The copies are counted by fingerprint, combined before the shuffle. Only wordings with more copies than make up a tenth of
    ``FLOOR`` in all texts are told, a bounded number; fewer copies make no difference.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for joined, _, _ in _chunks([t for t in batch.column(0).to_pylist() if t], COUNT_CHARS):
                codes = fold(joined)
                own, n = np.unique(_wordings(codes, slots(codes))[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], ["print", "n"])

    texts = documents.select("text")
    size = texts.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    many = texts.mapInArrow(prints, "print bigint, n bigint").groupBy("print").agg(F.sum("n").alias("n")).filter(F.col("n") > max(1, int(size * FLOOR / 10))).toArrow()
    return dict(zip(many["print"].to_pylist(), many["n"].to_pylist(), strict=True))


def prose_counts(documents: DataFrame, seeds: Seeds, copies: dict[int, int] | None = None) -> np.ndarray:
    """How often each n-gram of the seeds, and any other, occurs in all texts, in parts of ``WHOLE``. Dense arrays are counted by split and summed.

    Each wording counts once: n copies count 1/n each, so a notice stays rare in prose however many documents show it.
    ``copies`` are those of ``copied_wordings``. Wordings of the seeds, and what looks like a marked field, are not counted.
    """
    place, width = seeds.place, seeds.share.shape[1] + 1
    copies = copied_wordings(documents) if copies is None else copies
    texts = documents.select("text")
    parts = {k: WHOLE // n for k, n in copies.items()} | dict.fromkeys(seeds.prints.tolist(), 0)
    known = np.array(sorted(parts), np.int64)
    shared = documents.sparkSession.sparkContext.broadcast((place, known, np.array([parts[k] for k in known.tolist()], np.int64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, known, part = shared.value
        # sums are whole numbers below 2 ** 63
        sums, dense = np.zeros(width, np.int64), _Dense(width)
        for batch in batches:
            for joined, _, _ in _chunks([t for t in batch.column(0).to_pylist() if t], COUNT_CHARS):
                codes = fold(joined)
                grams = slots(codes)
                begin, own = _wordings(codes, grams)
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                weight = np.where(known[at] == own, part[at], WHOLE)
                of_gram = np.repeat(weight, np.diff(np.append(begin, len(codes))))[: len(grams)]
                for m in MARKED.finditer(joined) if any(mark in joined for mark in _DOUBLE) else ():
                    of_gram[m.start() - 1 : m.end()] = 0
                # those of a chunk are whole numbers below 2 ** 53
                sums += np.bincount(place[grams], of_gram, width).astype(np.int64)
        dense.add(np.zeros(width, np.uint8), np.arange(width), sums)
        yield from dense.take()

    blocks = sum_blocks(texts.mapInArrow(count, _BLOCKS))
    out = np.zeros(-(-width // BLOCK) * BLOCK, np.int64)
    for r in blocks.select("block", "counts").collect():  # as many blocks as the seeds need
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = r["counts"]
    out[:width] += PROSE_WEIGHT * WHOLE * np.bincount(place[slots(fold(PROSE_SEEDS))], minlength=width)
    out[width - 1] += max(0, LEAST_PROSE * WHOLE - out.sum())
    return out[:width]


def pieces(line: str) -> list[str]:
    """The sentences, field values and headings of a line, without paragraph marks."""
    out = []
    wide = "。" in line or "！" in line or "？" in line
    for piece in (_WIDE_BREAK if wide else _BREAK).split(line):
        bare = (piece[m.end() :] if (m := _MARK.match(piece)) else piece).strip()
        if bare and not bare.endswith(":"):  # a label alone is no value
            out.append(bare)
    return out


def _windows(found: list[str], seeds_place: np.ndarray, ratio: np.ndarray, slack: float = 0.0, lowest: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """By row of ratios and piece, the share that positive windows cover, and whether that and the mean make it residue."""
    joined = "\n" + "\n".join(found) + "\n"
    sizes = np.array([len(p) for p in found])
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    # n-grams from the line feed before a piece to the one after it
    n = np.maximum(sizes + 2 - ORDER + 1, 1)
    numbers = seeds_place[slots(np.concatenate([fold(joined), np.zeros(ORDER, np.uint32)]))].astype(np.int64)
    least = np.array([lowest if _SAYS.search(p) else WORD_LEAST for p in found])
    half = WINDOW // 2
    at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    low = np.maximum(at - half, np.repeat(first, n))
    high = np.minimum(at + half, np.repeat(first + n - 1, n)) + 1
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    cover, enough = np.zeros((len(ratio), len(found))), np.zeros((len(ratio), len(found)), bool)
    for i, of_number in enumerate(ratio):
        total = np.concatenate([[0.0], np.cumsum(of_number[numbers].astype(np.float64))])
        mean = (total[high] - total[low]) / (high - low)
        cover[i] = np.add.reduceat((mean > -slack).astype(np.float64), begin) / n
        enough[i] = (cover[i] >= COVERAGE) & ((total[first + n] - total[first]) / n >= least - slack)
    return cover, enough


def _likely(found: list[str], seeds_place: np.ndarray, top: np.ndarray, lowest: float) -> list[int]:
    """The pieces whose mean of the largest ratios is enough for any kind, as no kind reaches more than those do. The slack is for rounding."""
    codes = fold("\n" + "\n".join(found) + "\n")
    n = np.maximum(np.array([len(p) for p in found]) + 3 - ORDER, 1)
    first = np.concatenate([[0], np.cumsum([len(p) + 1 for p in found])[:-1]]).astype(np.int64)
    total = np.concatenate([[0.0], np.cumsum(top[seeds_place[slots(np.concatenate([codes, np.zeros(ORDER, np.uint32)]))]], dtype=np.float64)])
    return np.flatnonzero((total[first + n] - total[first]) / n >= min(lowest, WORD_LEAST) - 1e-6).tolist()


def judge(found: list[str], seeds_place: np.ndarray, ratio: np.ndarray, lowest: float = LEAST) -> list[str | None]:
    """The kind of residue that each piece is, or None."""
    if not found:
        return []
    top = ratio.max(axis=0)
    likely = np.array(_likely(found, seeds_place, top, lowest), np.int64)
    if len(likely):
        likely = likely[_windows([found[i] for i in likely.tolist()], seeds_place, top[None], 1e-6, lowest)[1][0]]
    best = np.full(len(found), -1)
    if len(likely):
        best_cover = np.zeros(len(likely))
        for kind, (cover, enough) in enumerate(zip(*_windows([found[i] for i in likely.tolist()], seeds_place, ratio, lowest=lowest), strict=True)):
            better = enough & (cover > best_cover)
            best[likely[better]], best_cover[better] = kind, cover[better]
    field = ratio[KINDS.index("field")]
    return [_checked(p, KINDS[b] if b >= 0 else None, lambda p=p: _spots(p, seeds_place, field)) for p, b in zip(found, best.tolist(), strict=True)]


def _runs(score: np.ndarray) -> np.ndarray:
    """Sums over SPOT n-grams from each on."""
    out = score[: max(0, len(score) - SPOT + 1)].copy()
    for i in range(1, SPOT):
        out += score[i : len(score) - SPOT + 1 + i]
    return out


def _spots(piece: str, seeds_place: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Where in a piece a model's n-grams in a row sum up to a spot: places of characters, ascending."""
    return np.flatnonzero(_runs(ratio[seeds_place[slots(fold(f"\n{piece}\n"))]]) >= SPOT_SUM) - 1


def _open_fields(piece: str, spots: np.ndarray) -> list[re.Match]:
    """The marked fields of a piece that the field model has a spot in and that are not quoted."""
    inside = lambda m: bool(len(spots)) and bool(((spots >= m.start() - 2) & (spots + SPOT + ORDER - 2 <= m.end() + 1)).any())
    return [m for m in MARKED.finditer(piece) if inside(m) and not _quoted(piece[: m.start()])]


def _left_open(piece: str, spots: np.ndarray) -> bool:
    """Whether a field stands open within a sentence that doesn't quote or treat it. Formulas are no sentences."""
    rest = MARKED.sub(" ", piece)
    return bool(_open_fields(piece, spots)) and bool(_LETTERS.search(rest)) and not _FORMULA.search(rest) and not _TREATS.search(rest)


def _quoted(before: str) -> bool:
    return before.count('"') % 2 == 1 or any(before.rfind(a) > before.rfind(b) for a, b in _QUOTES)


def _checked(piece: str, kind: str | None, field_spots) -> str | None:
    """The exact check of what the windows found: a prompt or empty value has to be that as a whole, a field may stand in a
    sentence. ``field_spots`` gives the spots of the field model; without one nothing is a field."""
    whole = OPEN_FIELD.fullmatch(piece)
    if (whole or MARKED.search(piece)) and len(spots := field_spots()) and (whole or _left_open(piece, spots)):
        return "field"
    if kind == "prompt":
        return kind if _PROMPT.fullmatch(piece) else None
    if kind is None or kind == "field":
        return None
    if _EMPTY.fullmatch(piece):
        return "empty"
    return kind if kind != "empty" and _LETTERS.search(piece) and not _HEADING.fullmatch(piece) else None


def _searched(documents: DataFrame, seeds: Seeds, ratio: np.ndarray, lowest: float = LEAST, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Every piece of residue: doc_id, kind, piece, n (how often it stands in the document). Only lines with a spot of one of the kinds are looked at."""
    # of fixed size: the seeds' n-grams
    shared = documents.sparkSession.sparkContext.broadcast((seeds.place, ratio, ratio[[KINDS.index(k) for k in kinds]].max(axis=0)))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, by_kind, top = shared.value
        for frame in frames:
            rows: dict[tuple[int, str, str], int] = {}
            ids = frame["doc_id"].tolist()
            for joined, starts, whose in _chunks([t or "" for t in frame["text"].tolist()]):
                codes = fold(joined)
                hits = np.flatnonzero(_runs(top[place[slots(codes)]]) >= SPOT_SUM)
                if not len(hits):
                    continue
                ends = np.flatnonzero(codes == 10)
                # an n-gram may begin with the line feed before its line
                lines = np.unique(np.searchsorted(ends, hits + 1))
                found, owner = [], []
                for line in lines[(lines > 0) & (lines < len(ends))].tolist():
                    begin = int(ends[line - 1]) + 1
                    mine = pieces(joined[begin : int(ends[line])])
                    found += mine
                    owner += [int(whose[np.searchsorted(starts, begin, side="right") - 1])] * len(mine)
                for piece, who, kind in zip(found, owner, judge(found, place, by_kind, lowest), strict=True):
                    if kind:
                        key = (ids[who], kind, piece)
                        rows[key] = rows.get(key, 0) + 1
            if rows:
                yield pd.DataFrame({"doc_id": [k[0] for k in rows], "kind": [k[1] for k in rows], "piece": [k[2] for k in rows], "n": list(rows.values())})

    return documents.select("doc_id", "text").filter("doc_id IS NOT NULL").mapInPandas(search, "doc_id bigint, kind string, piece string, n bigint")


def fitted(documents: DataFrame) -> tuple[Seeds, np.ndarray]:
    """The models and their log likelihood ratios, after self-training on all documents."""
    copies = copied_wordings(documents)
    texts = seed_texts()
    first = Seeds.fit(texts)
    found = _searched(documents, first, first.ratios(prose_counts(documents, first, copies)), LEARN_LEAST, LEARNING).filter(F.col("kind").isin(*LEARNING))
    often = found.groupBy("kind", "piece").agg(F.count_distinct("doc_id").alias("n")).filter(F.col("n") >= LEAST_COPIES)
    seeds = Seeds.fit(texts, Learned.of(materialize(often)))
    return seeds, seeds.ratios(prose_counts(documents, seeds, copies))


def residue(documents: DataFrame) -> DataFrame:
    """The documents with residue: doc_id, kind, n_pieces (how many pieces of that kind), example (the first, up to 200 characters).

    - One row for each document and kind. Null and empty texts have none; an empty table gives an empty result.
    - Whole texts are searched, however long. Repeated rows come out once; rows without a doc_id are left out.
    - Sentences that quote or treat such things, damaged formulas and marks for formulas, drawings or claims are no residue.
    """
    found = _searched(documents, *fitted(documents))
    # a repeated row gives the same pieces again
    once = found.groupBy("doc_id", "kind", "piece").agg(F.max("n").alias("n"))
    return once.groupBy("doc_id", "kind").agg(F.sum("n").alias("n_pieces"), F.min(F.substring("piece", 1, 200)).alias("example"))


def found_documents(documents: DataFrame) -> DataFrame:
    return residue(documents).select("doc_id").distinct()


def clean_documents(documents: DataFrame) -> DataFrame:
    """The documents without residue, with all their columns."""
    return documents.join(found_documents(documents), "doc_id", "left_anti").select(documents.columns)
