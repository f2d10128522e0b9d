"""Defaults: word lists, weights and thresholds. Every job takes its own in place of these."""

# ---- fixed values: lexicon of tone, words without accents ----
POSITIVE = {
    "lucro": .5, "lucros": .5, "recorde": .7, "alta": .4, "sobe": .45, "subiu": .45,
    "avanca": .35, "avancou": .35, "crescimento": .45, "cresce": .45, "cresceu": .45,
    "supera": .6, "superou": .6, "acima": .4, "melhor": .4, "forte": .3,
    "aprovacao": .4, "aprovado": .4, "aprova": .4, "acordo": .35, "contrato": .4,
    "dividendo": .5, "dividendos": .5, "proventos": .5, "jcp": .45, "recompra": .55,
    "upgrade": .7, "elevou": .45, "eleva": .45, "expansao": .4, "aquisicao": .35,
    "parceria": .3, "investimento": .3, "reducao de divida": .5, "desalavancagem": .45,
    "beat": .6, "outperform": .6, "buy": .5, "surged": .6, "rally": .5,
    "profit": .5, "record": .6, "beats": .6, "raises": .5, "upgraded": .7,
}
NEGATIVE = {
    "prejuizo": -.7, "queda": -.45, "cai": -.45, "caiu": -.45, "recuo": -.4,
    "recua": -.4, "despenca": -.7, "tombo": -.65, "perda": -.45, "perdas": -.5,
    "abaixo": -.4, "pior": -.45, "fraco": -.35, "frustra": -.55, "decepciona": -.6,
    "corte": -.45, "corta": -.45, "reduz": -.4, "reducao": -.35, "suspende": -.5,
    "suspensao": -.5, "cancela": -.5, "multa": -.5, "multado": -.5, "processo": -.3,
    "investigacao": -.5, "fraude": -.85, "greve": -.5, "paralisacao": -.5,
    "acidente": -.6, "vazamento": -.55, "rompimento": -.7, "downgrade": -.7,
    "rebaixou": -.6, "rebaixamento": -.6, "renuncia": -.45, "demissao": -.3,
    "liminar": -.4, "divida": -.3, "alavancagem": -.3, "despesa": -.2,
    "miss": -.6, "misses": -.6, "underperform": -.6, "sell": -.5, "plunge": -.7,
    "loss": -.6, "cuts": -.5, "downgraded": -.7, "probe": -.5, "lawsuit": -.4,
}
PHRASES = {
    "juros sobre o capital proprio": .5, "juros sobre capital proprio": .5,
    "acima do esperado": .55, "abaixo do esperado": -.55,
    "acima das expectativas": .55, "abaixo das expectativas": -.55,
    "aumento de capital": -.3, "sobras de acoes": -.25, "diluicao": -.4,
    "oferta subsequente": -.3, "follow on": -.3,
    "preco-alvo elevado": .6, "preco-alvo reduzido": -.6,
    "record loss": -.75, "record losses": -.75, "record low": -.6,
    "record decline": -.65, "record high": .6, "record profit": .75,
    "recorde de prejuizo": -.75, "prejuizo recorde": -.75,
    "fato relevante": .15, "pedido de recuperacao judicial": -.9,
    "recuperacao judicial": -.8, "day after": 0.0,
    "lucro liquido": .35, "prejuizo liquido": -.6,
    "better than expected": .55, "worse than expected": -.55,
}
NEGATORS = ["nao", "nao ha", "sem", "descarta", "nega", "negou", "desmente", "not", "no", "denies"]
HEDGES = ["pode", "poderia", "deve", "estuda", "avalia", "cogita", "rumor", "boato", "especula", "may", "could", "weighs", "considers", "rumored"]
EVENTS = [  # first match counts: name, pattern, usual weight
    ("earnings", r"\b(balanco|resultado|trimestre|lucro liquido|ebitda|earnings)\b", .9),
    ("guidance", r"\b(guidance|projecao|perspectiva|outlook)\b", .95),
    ("mna", r"\b(aquisicao|fusao|compra de|incorporacao|merger|acquisition)\b", .9),
    ("rating", r"\b(upgrade|downgrade|preco-alvo|recomendacao|rating|rebaixou)\b", .7),
    ("dividend", r"\b(dividendo|dividendos|jcp|proventos|recompra|juros sobre (o )?capital proprio)\b", .75),
    ("equity_offer", r"\b(aumento de capital|sobras de acoes|oferta subsequente|follow on|diluicao|subscricao)\b", .7),
    ("regulatory", r"\b(cade|cvm|aneel|anp|anatel|multa|liminar|regulador|probe)\b", .8),
    ("operational", r"\b(greve|paralisacao|acidente|vazamento|rompimento|producao)\b", .8),
    ("distress", r"\b(recuperacao judicial|falencia|default|calote|rolagem de divida|covenant)\b", .95),
    ("management", r"\b(ceo|cfo|presidente|conselho|renuncia|assembleia)\b", .55),
    ("macro_linked", r"\b(selic|copom|cambio|dolar|inflacao|ipca|petroleo brent|minerio)\b", .4),
]
ADVERSE = [
    r"apesar d[ao]s? resistencia d[ao]s?", r"apesar d[ao]s?", r"contra", r"resistencia d[ao]s?", r"enfrenta", r"derrota d[ao]s?",
    r"em desfavor d[ao]s?", r"prejudica", r"as custas d[ao]s?", r"reduzir? (?:o )?poder d[ao]s?", r"reduzir? (?:a )?concentracao",
]
FAVOURABLE = [r"a favor d[ao]s?", r"beneficia", r"vitoria d[ao]s?", r"em favor d[ao]s?", r"favorece"]
LANGUAGES = ["portuguese", "english", "pt", "en", "pt-br", "en-us", "en-gb"]

# ---- fixed values: time orientation and nature of an event ----
PAST = [
    r"\b(anunci(?:a|ou)|divulg(?:a|ou)|registr(?:a|ou)|fech(?:a|ou)|encerr(?:a|ou)|conclu(?:i|iu)|aprov(?:a|ou)|decid(?:e|iu)|protocol(?:a|ou)|apresent(?:a|ou)|assin(?:a|ou)|pag(?:a|ou)|obt(?:em|eve)|exting(?:ue|uiu)|conden(?:a|ou)|determin(?:a|ou)|public(?:a|ou)|elev(?:a|ou)|reduz(?:iu)?|teve|foi)\b",
    r"\b(no \d+t\d+|no trimestre|no ano passado|em \d{4}|ontem|na semana passada|na (?:segunda|terca|quarta|quinta|sexta) passada)\b",
]
PRESENT = [
    r"\b(negocia|discute|avalia|analisa|opera|enfrenta|disputa|tramita|esta em|segue em|mantem)\b",
    r"\b(em curso|em andamento|nesta (?:segunda|terca|quarta|quinta|sexta)|hoje)\b",
]
FUTURE = [
    r"\b(pode|podera|deve|devera|planeja|pretende|projeta|preve|estima|espera|vai|ira|aguarda|solicita|pede|pleiteia)\b",
    r"\b(guidance|projecao|perspectiva|outlook|meta para|previsao)\b",
    r"\b(recurso|apelacao|embargos|liminar pendente|ainda pode|a decidir|em julgamento|sera julgado|aguarda decisao)\b",
    r"\b(a partir de|no proximo|no futuro|ate \d{4})\b",
    r"\b\w+(?:ara|erao|ira|irao|era|arao)\b",
    r"\b(sinaliza|promete|anuncia que (?:vai|ira)|preve que)\b",
]
NATURES = [  # first match counts
    ("judicial", r"\b(mpf|ministerio publico|justica federal|justica|trf\d?|stj|stf|tst|acao civil publica|liminar|recurso|apelacao|embargos|sentenca|decisao judicial|juiz|desembargador|processo judicial|acao judicial|interdito|tutela|agravo)\b"),
    ("legislativo", r"\b(projeto de lei|pl \d+|pec|medida provisoria|mp \d+|camara dos deputados|senado|congresso|relator|votacao no plenario|sancao presidencial|decreto|consulta publica|tomada de subsidio|audiencia publica)\b"),
    ("calendario", r"\b(calendario de (?:eventos|resultados)|data de divulgacao|divulgara (?:o )?(?:balanco|resultado)|agenda de resultados|fato relevante|comunicado ao mercado)\b"),
    ("macro", r"\b(selic|copom|ipca|igp-m|inflacao|pib|cambio|dolar|juros basicos|payroll|fed|banco central|politica monetaria)\b"),
]
NATURE_OF_EVENT = {"earnings": "corporativo", "guidance": "corporativo", "mna": "corporativo", "rating": "corporativo", "dividend": "corporativo", "equity_offer": "corporativo", "management": "corporativo", "distress": "corporativo", "operational": "corporativo", "macro_linked": "macro", "regulatory": "judicial"}

# ---- fixed values: arousal ----
AROUSAL = {
    "fraude": 1.0, "rombo": .95, "falencia": 1.0, "recuperacao judicial": 1.0, "colapso": .9, "despenca": .85, "derrete": .85, "tombo": .8, "panico": 1.0,
    "crise": .8, "risco": .55, "ameaca": .7, "alerta": .6, "investigacao": .75, "denuncia": .75, "escandalo": .9, "vazamento": .7, "rompimento": .85,
    "acidente": .8, "morte": .8, "greve": .65, "paralisacao": .65, "default": .9, "calote": .95, "inadimplencia": .7, "multa": .6,
    "corte": .5, "demissao": .6, "fechamento": .55, "suspensao": .6, "incerteza": .6, "indefinicao": .5, "impasse": .55, "tensao": .6,
    "urgente": .7, "imediato": .5, "emergencia": .85, "inesperado": .7, "surpresa": .6, "reviravolta": .7, "disparou": .7, "dispara": .7,
    "recorde": .6, "historico": .5, "sem precedentes": .9,
    "fraud": 1.0, "collapse": .9, "plunge": .85, "crash": 1.0, "panic": 1.0, "crisis": .8, "risk": .55, "probe": .75, "lawsuit": .6,
    "bankruptcy": 1.0, "strike": .65, "emergency": .85, "surge": .7, "soars": .7, "record": .6, "unprecedented": .9, "warning": .65,
}
CASCADE_HOURS = 2.0

# ---- fixed values: near-duplicate stories ----
STOP_WORDS = [
    "a", "o", "as", "os", "de", "do", "da", "dos", "das", "e", "em", "no", "na", "nos", "nas", "um", "uma", "para", "por", "com", "que", "ao", "aos", "se", "sobre", "apos", "ate",
    "the", "of", "to", "in", "on", "for", "and", "an", "is", "at", "by", "with", "from",
]
MAGNITUDES = {"mil": 1e3, "milhao": 1e6, "milhoes": 1e6, "mi": 1e6, "bilhao": 1e9, "bilhoes": 1e9, "bi": 1e9, "trilhao": 1e12, "tri": 1e12, "million": 1e6, "billion": 1e9}
JACCARD_MIN, HAMMING_MAX, JACCARD_WITH_FIGURE = 0.55, 12, 0.25

# ---- fixed values: entity linking ----
MARKET_WORDS = [
    "acao", "acoes", "papel", "papeis", "bolsa", "b3", "ibovespa", "ticker", "lucro", "prejuizo", "receita", "ebitda", "margem", "balanco", "resultado",
    "trimestre", "guidance", "projecao", "dividendo", "dividendos", "jcp", "proventos", "recompra", "oferta", "follow", "ipo", "debenture",
    "aquisicao", "fusao", "incorporacao", "venda", "desinvestimento", "investimento", "capex", "contrato", "concessao", "leilao",
    "upgrade", "downgrade", "recomendacao", "preco-alvo", "target", "analista", "analistas", "corretora", "banco", "research",
    "acionista", "acionistas", "conselho", "assembleia", "ceo", "cfo", "presidente", "diretoria", "renuncia", "demissao",
    "producao", "reservas", "exportacao", "importacao", "demanda", "multa", "cade", "cvm", "aneel", "anp", "anatel", "regulador", "liminar",
    "greve", "paralisacao", "acidente", "rompimento", "vazamento", "rating", "divida", "alavancagem", "caixa", "fluxo",
    "shares", "stock", "earnings", "revenue", "profit", "loss", "dividend", "merger", "acquisition",
]
NOISE_WORDS = ["futebol", "patrocinio", "carnaval", "novela", "celebridade", "show", "campeonato", "atleta", "filme", "serie", "receita culinaria", "horoscopo", "sorteio", "concurso cultural"]
AMBIGUOUS_ALIASES = ["vale", "b3", "weg", "oi", "gol", "mover", "ambev brasil"]
NOBODY = "__none__"

# ---- fixed values: weights and gates ----
ZONE = "America/Sao_Paulo"
SESSION_HOURS = (10, 17)
HALF_LIFE_HOURS, WINDOW_HOURS, DEFAULT_SOURCE_WEIGHT = 8.0, 36, 0.35
SURPRISE_WEIGHT, SURPRISE_HALF_LIFE_DAYS, SURPRISE_CAP = 0.12, 10.0, 0.30
SHRINK, MIN_SKILL, MIN_CALIBRATION = 2.0, 0.01, 120
SECTOR_WEIGHT, THEME_WEIGHT, MIN_SHARE, TOP_DRIVERS = 0.35, 0.25, 0.08, 4
ALARM_DEFAULTS = {"min_edge": 0.12, "min_n_eff": 2.0, "cooldown_min": 90, "require_calibrated": True, "require_novelty": True, "direction": "both"}

# ---- fixed values: filings, statements, documents ----
FILING_KINDS = {
    "Fato Relevante": "FATO_RELEVANTE", "Comunicado ao Mercado": "COMUNICADO", "Dados Econômico-Financeiros": "RESULTADO", "Press-release de Resultados": "RESULTADO",
    "Apresentações a analistas/agentes do mercado": "APRESENTACAO", "Calendário de Eventos Corporativos": "CALENDARIO", "Informação Prestada às Bolsas Estrangeiras": "BOLSA_ESTRANGEIRA",
    "Política de Divulgação de Ato ou Fato Relevante": "POLITICA", "Reunião da Administração": "GOVERNANCA", "Assembleia": "GOVERNANCA",
}
STATEMENT_CODES = {"3.01": "receita_liquida", "3.02": "custo", "3.03": "lucro_bruto", "3.04": "despesas_op", "3.05": "ebit", "3.06": "resultado_financeiro", "3.07": "lucro_antes_tributos", "3.11": "lucro_liquido"}
AMBIGUOUS_CODES = {"3.05": {"ebit": ["resultado antes do resultado financeiro", "resultado antes das receitas", "lucro operacional"], "outras_receitas_despesas": ["outras receitas e despesas"]}}
REPORT_TERMS = ["receita líquida", "ebitda", "lucro líquido", "prejuízo", "dívida líquida", "fluxo de caixa", "guidance", "provisão", "contingência", "impairment"]
DOCUMENT_HINTS = [".pdf", ".xlsx", ".xls", ".zip", "/download/", "download=", "arquivo=", "attachment", "getfile", "fileid", "documento.pdf"]
NOT_DOCUMENTS = ["wp-json", "oembed", "?page_id=", "/feed", "/wp-admin", "mailto:", "javascript:", "/tag/", "/category/"]
RELEASE_DAYS = {"IPCA": 10, "IGP-M": 30, "Taxa de desocupação": 28, "Câmbio": 1}
EVENT_RULES = {"CPI EUA": ("DXY", "day12"), "Payroll EUA": ("DXY", "first_friday"), "PMI China": ("HSI", "day1")}
