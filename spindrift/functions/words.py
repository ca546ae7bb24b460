"""Fixed values of query rewriting: stop words, and technical English terms for words of a question."""

# Portuguese stop words.
STOP_PT = (
    "o a os as um uma uns umas de do da dos das em no na nos nas por para com sem sob sobre e ou mas que se como quando "
    "ao aos pelo pela pelos pelas este esta esse essa aquele aquela isto isso aquilo eu tu ele ela nos vos eles elas "
    "meu minha seu sua nosso nossa ser estar ter haver fazer ir nao mais muito tambem ja ainda"
).split()

# English stop words.
STOP_EN = (
    "the a an is are was were be been being have has had do does did will would could should may might can "
    "in on at to for of with by from and or but not no if then than this that these those it its "
    "i you he she we they my your his her our their what which who how when where why"
).split()

STOP = sorted({*STOP_PT, *STOP_EN})

# Word, then the terms that stand for it in code.
TERMS_TEXT = """
feature: feature access gate permission capability
funcionalidade: feature access gate permission capability
plano: plan subscription tier pricing
planos: plan subscription tier pricing
assinatura: subscription plan tier billing
assinaturas: subscription plan tier billing
preco: price pricing cost billing
limita: limit restrict guard check validate cap quota
limite: limit restrict guard check validate cap quota
limites: limit restrict guard check validate cap quota
limitacao: limit restrict quota cap threshold
cota: quota limit cap allowance
threshold: threshold limit cap boundary
uso: usage access consumption utilization
utilizacao: usage utilization consumption
consumo: consumption usage utilization
autenticacao: auth authentication token session jwt
autenticar: auth authenticate login token session
autorizacao: authorization permission access role scope
autorizar: authorize permission access role
login: login auth authenticate session credential
senha: password credential hash bcrypt
token: token jwt session bearer access_token
erro: error exception failure catch throw
erros: error exception failure catch throw
excecao: exception error catch throw raise
falha: failure error exception fault
falhar: fail error exception fault
usuario: user account member profile
usuarios: user account member profile
conta: account user profile tenant
contas: account user profile tenant
perfil: profile user account settings
pagamento: payment billing invoice charge transaction
pagamentos: payment billing invoice charge transaction
cobranca: billing charge invoice payment
fatura: invoice billing payment charge
cartao: card credit_card stripe payment
notificacao: notification notify alert message event
notificacoes: notification notify alert message event
email: email mail smtp message notification
mensagem: message notification event payload
configuracao: config configuration settings options params
configuracoes: config configuration settings options
config: config configuration settings options
banco: database db storage repository persistence
dados: data model schema record entity
repositorio: repository repo storage dao service
salvar: save persist store write upsert
buscar: fetch query find search retrieve get
rota: route endpoint path handler controller
rotas: route endpoint path handler controller
endpoint: endpoint route handler controller api
requisicao: request http api endpoint handler
cache: cache memoize redis ttl invalidate
cachear: cache memoize store ttl
evento: event webhook trigger dispatch emit
eventos: event webhook trigger dispatch emit
validacao: validation validate schema constraint check
validar: validate check verify constraint schema
log: log logging monitor trace audit
logs: log logging monitor trace audit
monitorar: monitor observe track log metric
teste: test spec mock assert fixture
testes: test spec mock assert fixture
tarefa: task job worker background queue
fila: queue worker background job async
"""
TERMS = {key: terms.split() for key, terms in (line.split(": ") for line in TERMS_TEXT.strip().splitlines())}

#: Suffixes of which one is taken off a normalised name.
SUFFIXES = ("service", "controller", "provider", "widget", "state", "screen", "handler", "guard")

#: Language by file extension.
LANGUAGES = {".py": "python", ".dart": "dart", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript"}

#: Names and globs that a scan always leaves out.
IGNORED = "__pycache__ node_modules .git *.pyc *.lock *.g.dart .dart_tool build .venv venv .mypy_cache .pytest_cache dist *.egg-info".split()
