"""Word lists and patterns that results depend on, whole and in their natural order.

Patterns read folded text (lower case, no accents) unless said otherwise.  Nothing here is logic.
"""

# ---------------------------------------------------------------- fixed values: clauses

NEGATION = r"\b(?:nao|nem|nunca|jamais|sem|exceto|salvo)\b"
RESTRICTION = r"\b(?:nao|nem|nunca|jamais|sem|exceto|salvo)\b|\bevit\w*|\bcontraindic\w*|\bproib\w*|\bdesaconselh\w*"
ABSENCE = (
    r"\bnao\s+(?:foi\s+)?(?:estudad\w*|avaliad\w*|investigad\w*|testad\w*)\b"
    r"|\bnao\s+(?:foram|foi|sao|e|ha|houve|existem|se\s+(?:observ\w+|conhec\w+|sabe|esper\w+|identific\w+))"
    r"(?:\s+\w+){0,4}?\s*(?:realizad\w*|observad\w*|identificad\w*|conhecid\w*|relatad\w*"
    r"|descrit\w*|esperad\w*|avaliad\w*|estudad\w*|encontrad\w*|notificad\w*|evidenciad\w*|demonstrad\w*)"
    r"|\bnao\s+se\s+(?:sabe|conhece|observ\w+|esper\w+)"
    r"|\bnao\s+(?:parec\w*\s+|deve\w*\s+|sao\s+esperad\w*\s+)?"
    r"(?:alter\w+|afet\w+|modific\w+|influenci\w+|interfer\w+)"
    r"|\bsem\s+(?:nenhum\w*\s+)?(?:impacto|alteracao|efeito|interferencia)\b"
    r"|\bnenhuma\s+interac\w+|\bdesconhec\w+|\bnao\s+ha\s+(?:relatos|dados|estudos|informac\w+)"
    r"|\bnao\s+existem\s+(?:dados|estudos|relatos)"
)
EXTRA_ABSENCE = (
    r"\bnao\s+houve\s+(?:\w+\s+){0,3}?(?:alterac|interac|efeito|mudanc|diferenc|aument|reduc|diminuic)\w*"
    r"|\bnao\s+interag\w*"
    r"|\bnao\s+(?:apresent|demonstr|mostr|produz|caus|result|revel)\w*\s+(?:\w+\s+){0,3}?"
    r"(?:interac|alterac|efeito|mudanc|diferenc)\w*"
    r"|\bnenhum\w*\s+(?:\w+\s+){0,2}?(?:interac|alterac|efeito)\w*"
    r"|\bnao\s+(?:sao|foram|e|foi)\s+(?:\w+\s+){0,2}?(?:clinicamente\s+)?(?:significativ|relevant)\w*"
    r"|\bnao\s+(?:ha|existem|estao\s+disponiveis|foram\s+encontrad\w+)\s+(?:\w+\s+){0,3}?"
    r"(?:dados|estudos|relatos|informac\w*|evidencias)"
    r"|\b(?:dados|estudos|informac\w+)\s+(?:\w+\s+){0,3}?nao\s+(?:estao\s+)?disponive\w*"
    r"|\bnao\s+(?:teve|tem|tiveram|possui\w*|exerce\w*|provoc\w*)\s+(?:\w+\s+){0,3}?"
    r"(?:efeito|interac|alterac|impacto|influencia|mudanc)\w*"
    r"|\bnao\s+(?:inib|induz|potencializ|aument|diminu|reduz|alter|modific|afet)\w*\s+(?:\w+\s+){0,2}?"
    r"(?:metabolismo|efeito|concentrac|absorc|depurac|eliminac|farmacocinetica|exposicao|atividade"
    r"|nivel|niveis|biodisponibilidade|ligacao)\w*"
    r"|\bnao\s+(?:foram|foi)\s+(?:\w+\s+){0,2}?(?:conduzid|efetuad|investigad|testad|examinad)\w*"
    r"|\bnao\s+(?:havia|haviam|houveram|existia|existiam)\s+(?:\w+\s+){0,3}?"
    r"(?:interac|alterac|efeito|diferenc|mudanc)\w*"
)
RECOMMENDATION = (
    r"\bnao\s+(?:deve|devem|se\s+recomenda|e\s+recomendad\w*|sao\s+recomendad\w*)"
    r"|\bevit\w*|\bcontraindic\w*|\bcautela\b|\bmonitor\w*|\bdeve(?:m)?\s+ser\b"
    r"|\brecomenda-se\b|\brecomendad\w*|\bdeve-se\b|\bajust\w*\s+(?:de\s+|da\s+)?dose"
    r"|\bsuspen\w*|\bdescontinu\w*|\binterromp\w*"
)
CLAUSE_END = (
    r";\s+|\.\s+|,\s+(?:mas|porem|entretanto|contudo|todavia|no\s+entanto)\s+"
    r"|\s+(?:porem|entretanto|contudo|todavia|no\s+entanto),?\s+"
)
QUANTITY = (
    r"(\d+(?:[.,]\d+)?)\s*(?:mg|g|mcg|ug|µg|μg|ml|l|ui|u\.i\.|meq|mmol|gotas?|comprimidos?|capsulas?)"
    r"(?:\s*/\s*(?:kg|dia|m2|m²|h|hora|semana))?(?![a-z])"
    r"|(\d+(?:[.,]\d+)?)\s+vezes\s+(?:ao|por)\s+(?:dia|semana)"
    r"|a\s+cada\s+(\d+(?:[.,]\d+)?)\s+(?:horas|h|dias)"
)
QUALITATIVE_DOSE = (
    r"\b(?:altas?\s+doses?|doses?\s+(?:altas?|elevadas?|superiores|acima|maiores|terapeuticas|baixas?))\b"
    r"|\buso\s+(?:prolongado|cronico)\b|\blongo\s+prazo\b"
)
DOSE_IN_SUMMARY = r"\bdos\w*|prolongad\w*|cronic\w*|longo\s+prazo"
ROUTE = (
    r"\b(?:via|uso|forma|apresentacao|administracao|solucao|suspensao)\s+"
    r"(oral|intravenos\w*|endovenos\w*|intramuscular\w*|subcutane\w*|topic\w*|oftalmic\w*"
    r"|inalatori\w*|intratecal|retal|vaginal|transdermic\w*|sublingual|nasal|injetave\w*)"
    r"|\b(intravenos\w*|endovenos\w*|intramuscular\w*|subcutane\w*|injetave\w*|intratecal)\b"
)
INCREASE = r"\b(?:aument\w*|elev\w*|potencializ\w*|intensific\w*|acentu\w*|maior\w*)"
DECREASE = r"\b(?:diminu\w*|reduz\w*|reduc\w*|baix\w*|atenu\w*|menor\w*|inibi\w*|antagoni\w*)"
SEVERITY = r"\b(grave\w*|gravidade|leve\w*|moderad\w*|sever\w*|seri[oa]s?|fata\w*|leta\w*|perigos\w*)\b"

# ---------------------------------------------------------------- fixed values: identification

# On the text as it is written: where a passage ends, and the labels of structured blocks.
LIST_MARKS = "-•▪●◦*"
PASSAGE_END = r"\n[ \t]*\n|\n(?=[ \t]*[-•▪●◦*])|(?<=[.;])\s+(?=[A-ZÁÉÍÓÚÂÊÔÃÕÇ\d•▪●◦*-])"
BLOCK_LABEL = r"(?im)(?:^|(?<=[.;])\s+)[ \t]*(?P<tipo>medicamentos?|efeitos?\s+(?:da\s+)?intera[çc][aã]o)\s*:"
BLOCK_TOPIC = r"\n\s*\d{1,2}[.)]\s+[A-ZÁÉÍÓÚÇ][A-ZÁÉÍÓÚÇ \t]{5,}"
EXCEPTION = r"\b(?:exceto|salvo|excluindo|com excecao d[aeo]s?|a excecao d[aeo]s?|mas\s+nao)\b"
EXCIPIENTS = r"^atencao\s*:?\s*contem\b|\bexcipientes?\b|\bcorantes?\b"
ENANTIOMER_PREFIXES = ("levo", "lev", "dextro", "dex", "es", "ar")
CONTEXTUAL = (
    "calcio", "magnesio", "potassio", "ferro", "zinco",
    "dopamina", "norepinefrina", "epinefrina", "noradrenalina", "adrenalina", "serotonina", "histamina",
)
CONTEXT_BEFORE = (
    "nivel", "niveis", "concentracao", "concentracoes", "serico", "serica", "sericos", "sericas",
    "plasmatico", "plasmatica", "plasmaticos", "plasmaticas", "sanguineo", "sanguinea", "urinario",
    "urinaria", "excrecao", "eliminacao", "perda", "perdas", "reabsorcao", "retencao", "deplecao",
    "ligacao", "ligado", "ligada", "ligados", "dosagem", "determinacao", "teste", "testes", "exame",
    "exames", "valor", "valores", "taxa", "taxas", "metabolismo", "homeostase", "equilibrio",
    "balanco", "poupador", "poupadores", "depletor", "depletores", "espoliador", "espoliadores",
    "canal", "canais", "antagonista", "antagonistas", "agonista", "agonistas", "bloqueador",
    "bloqueadores", "receptor", "receptores", "recaptacao", "liberacao", "transportador",
    "transportadores", "influxo", "fluxo", "mobilizacao", "transporte", "oxido", "dioxido",
)
CONTEXT_AFTER = (
    "serico", "serica", "sericos", "sericas", "plasmatico", "plasmatica", "sanguineo", "sanguinea",
    "urinario", "urinaria", "ionico", "ionizado", "corporal", "intracelular", "extracelular",
    "estriatal", "endogena", "endogeno",
)
# Names of the catalogue that are no mention of a medicine, one per line; # begins a comment.
IGNORED_TERMS = """
limiar
nesta
dupla
neural
versa
rosa
halo
aria
zina
kelly
triazol
proteina
proteinas
proteina c
proteina s
glicose
agua
sodio
oxigenio
triglicerides
alanina
albumina serica
ureia
iodo
trombina
tirosina
serina
treonina
aminoacido
aminoacidos
bicarbonato
acetato
citrato
osmolaridade
proteina total
acidos graxos livres
sais minerais
bario
CHO
cloreto de sodio
cloreto de sodio 0,9%
solucao de glicose
solucao glicofisiologica
ringer
ringer com lactato
solucao de ringer
solucao de ringer com lactato
agua para injecao
agua para injetaveis
agua para injecao q.s.p.
lactose
lactose monoidratada
galactose
sacarose
maltose
hipromelose
propilenoglicol
povidona
glicerol
oleo de soja
azul de indigotina
amarelo de tartrazina
enxofre
acido estearico
benzoato de sodio
sacarina sodica
gelatina
glicerina
oleo de oliva
comprimido
revestido
dura
cloreto
sodica
RDC 60/12
xarope
gliconato
ferroso
hidratado
monoidratado
medoxomila
VPS04
VPS20
plas trans
sodio Na
cloreto Cl
CLO
alcool
etanol
"""

# ---------------------------------------------------------------- fixed values: targets

# First words that name an effect, a dose or a function instead of something taken.
GENERIC_HEADS = (
    "droga", "drogas", "medicamento", "medicamentos", "farmaco", "farmacos",
    "substancia", "substancias", "produto", "produtos", "agente", "agentes",
    "alteracao", "alteracoes", "teste", "testes", "exame", "exames", "efeito",
    "efeitos", "sistema", "tratamento", "paciente", "pacientes", "dose", "doses",
    "funcao", "fluxo", "retencao", "mucosa", "nivel", "niveis", "tempo", "risco",
    "absorcao", "excrecao", "eliminacao", "concentracao", "concentracoes",
    "toxicidade", "sangramento", "hemostasia", "uso", "administracao",
)
# Words of faithful paraphrases that do not count as lexical support.
GENERIC_WORDS = (
    "evitar", "evite", "evita", "usar", "utilizar", "utilizado", "utilizados", "uso",
    "usado", "usados", "usada", "administrar", "administrado", "administrados",
    "administracao", "conjunto", "conjunta", "concomitante", "concomitantemente",
    "associacao", "associado", "associados", "juntos", "junto", "pode", "podem",
    "tratamento", "medicamento", "medicamentos", "deve", "devem", "quando",
    "durante", "pacientes", "paciente", "outros", "outras", "este", "esta",
    "isso", "essa", "esse", "como", "pelo", "pela", "entre", "sobre", "seus",
    "suas", "tambem", "ainda", "mesmo", "mesma", "presenca", "possivel",
    "recomenda", "recomendado", "recomendada", "recomendacao", "orienta",
)
STOP_WORDS = (
    "a", "o", "as", "os", "de", "da", "do", "das", "dos", "e", "em", "com",
    "por", "para", "ou", "na", "no", "nas", "nos", "um", "uma", "the",
)

# ---------------------------------------------------------------- fixed values: substances

SALT_BEFORE = (
    r"^(?:(?:mono|di)?cloridrato|hidrocloreto|bromidrato|hidrobrometo|brometo|maleato|mesilato|"
    r"besilato|napsilato|(?:hemi)?succinato|(?:hemi|bi)?tartarato|(?:hemi)?fumarato|citrato|"
    r"(?:bis)?sulfato|fosfato|acetato|(?:di)?propionato|valerato|butirato|lactato|gluconato|"
    r"estearato|palmitato|pamoato|embonato|tosilato|nitrato|carbonato|oxalato|hiclato|decanoato|"
    r"enantato|cipionato|undecilato|furoato|acetonido|aceponato) de "
)
SALT_AFTER = (
    r" (?:(?:di)?sodic[oa]|potassic[oa]|calcic[oa]|magnesic[oa]|hiclato|trometamol|base"
    r"|(?:mono|di|tri|sesqui|hemi)? ?hidratad[oa]|monoidratad[oa]|anidr[oa]"
    r"|de (?:sodio|potassio|calcio|magnesio|trometamol))$"
)
# What is left of a salt whose substance is the anion: no key of its own.
ANIONS = (
    "cloreto", "bicarbonato", "carbonato", "fosfato", "sulfato", "citrato", "lactato", "acetato",
    "gluconato", "hidroxido", "oxido", "iodeto", "fluoreto", "nitrato", "salicilato", "silicato",
    "trissilicato",
)
# On composition lines as they are written.
EXCIPIENT_LABEL = r"(?i)^\s*[*\-•]?\s*(?:excipientes?|ve[ií]culos?|componentes?\s+inativos?|outros\s+componentes|ingredientes?\s+inativos?)\b"
NEW_BLOCK = r"(?i)^\s*(?:cada\b|composi[cç][aã]o|apresenta[cç][aã]o|princ[ií]pios?\s+ativos?)"
NOT_CONTAINED = (
    r"(?i)\bn[aã]o\s+cont[eé]m\b|\bisent[oa]s?\s+de\b|\blivres?\s+de\b|\bsem\s+(?:adi[cç][aã]o\s+de\s+)?(?:a[cç][uú]car|lactose|gl[uú]ten|conservantes?)\b"
)
EQUIVALENCE = (
    r"(?i)(?:equivalente|correspondente|corresponde)s?\s+a\s+"
    r"(?:[\d.,]+\s*(?:mg|g|mcg|µg|μg|ui|u\.i\.|%|ml|meq|mmol)(?![a-z])\.?\s*(?:\([^)]*\)\s*)?)?"
    r"(?:de\s+|do\s+|da\s+)?"
    r"([^\d();,*\n.]+?)"
    r"\s*(?:\bbase\b)?\s*(?=[)*,;.\n]|$)"
)

# ---------------------------------------------------------------- fixed values: sections

MAIN_TITLES = (
    "indicacoes",
    "contraindicacoes",
    "advertencias",
    "posologia",
    "posologia e modo de usar",
    "armazenamento",
    "advertencias e precaucoes",
    "reacoes adversas",
    "eventos adversos e alteracoes de exames laboratoriais",
    "eventos adversos e alteracoes de exames laboratorias",
    "cuidados de armazenamento",
    "cuidados de armazenamento do medicamento",
    "superdose",
    "superdosagem",
    "dizeres legais",
    "onde como e por quanto tempo posso guardar",
    "onde, como e por quanto tempo posso guardar este medicamento",
    "onde como e por quanto tempo posso guardar este medicamento",
    "quais os males que este medicamento pode me causar",
    "o que fazer se alguem usar uma quantidade maior",
    "o que fazer se alguem usar uma quantidade maior do que a indicada deste medicamento",
)
SHORT_ANSWERS = (
    "nao existem", "nao existe", "nao existem interacoes",
    "nao ha", "nao ha interacoes", "nenhuma", "nenhuma conhecida",
    "nao conhecidas", "nao relatadas", "nao descritas",
    "nao se aplica", "desconhecidas", "inexistentes",
    "nao aplicavel", "nao sao conhecidas", "nao foram descritas", "nao sao descritas",
    "nao apresenta",
)
LABEL_WORDS = (
    "interacoes medicamentosas indicacoes contraindicacoes advertencias precaucoes "
    "reacoes adversas cuidados armazenamento medicamento medicamentos posologia "
    "modo usar superdose dizeres legais apresentacao composicao resultados eficacia "
    "notificacao alteracao alteracoes inclusao inicial texto bula excipiente maior "
    "moderada de da do das dos e em para por no na o a "
    "mg ml g mcg sol oral cx fr plas opc got x emb hosp ct vp vps similar rdc"
)
ADMIN_HEADERS = ("submissao eletronica", "peticao/notificacao", "itens de bula", "apresentacoes relacionadas", "data de aprovacao")
ADMIN_FORMAL = ("texto de bula", "alteracao de texto", "inclusao inicial", "dados das alteracoes")
ADMIN_LABELS = ("vps", "vp", "assunto", "versoes", "expediente", "apresentacoes")
PARENT_TOPICS = ("caracteristicas farmacologicas", "advertencias", "reacoes adversas")
