"""Vocabularies as data: fixed values that results must equal."""

from __future__ import annotations

#: File categories that old names map to (fixed values).
LEGACY_CATEGORIES = {"course-material": "material-de-aula", "exams": "provas", "exercise-lists": "listas", "rubrics": "gabaritos", "schedule": "cronograma", "references": "referencias", "photos-of-exams": "fotos-de-prova", "answer-keys": "gabaritos", "other": "outros"}
EXAM, EXERCISE, CODE, ASSIGNMENT, WHITEBOARD = ["provas", "fotos-de-prova"], ["listas", "gabaritos"], ["codigo-professor", "codigo-aluno"], ["trabalhos"], ["quadro-branco"]
#: When to open an entry, and the categories of each use (fixed values).
USES = [
    ("teoria base", ["material-de-aula", "slides", "apostila"]), ("provas e revisão", EXAM), ("exercícios", EXERCISE), ("trabalhos", ASSIGNMENT), ("exemplos de código", CODE),
    ("explicações do professor", WHITEBOARD), ("referência geral", ["cronograma", "bibliografia", "referencias"]),
]
#: Categories of the whole course; extensions of code files and their languages; branches of students; names of profiles (fixed values).
NO_TIMELINE = ["cronograma", "bibliografia", "referencias"]
CODE_EXTENSIONS = ["py", "js", "ts", "jsx", "tsx", "java", "c", "cpp", "h", "hpp", "cs", "go", "rs", "rb", "php", "swift", "kt", "scala", "r", "m", "sh", "bat", "ps1", "sql", "html", "css", "scss", "ipynb", "thy"]
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "jsx": "jsx", "tsx": "tsx", "java": "java", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp", "cs": "csharp", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "r": "r", "sh": "bash", "bat": "batch", "ps1": "powershell", "sql": "sql", "html": "html", "css": "css", "scss": "scss", "ipynb": "json", "thy": "isabelle"}
STUDENT_BRANCHES = ["main", "master", "minha-solucao", "aluno", "student"]
PROFILE_ALIASES = {"": "auto", "auto": "auto", "general": "auto", "math_light": "math_heavy", "math_heavy": "math_heavy", "layout_heavy": "diagram_heavy", "diagram_heavy": "diagram_heavy", "exam_pdf": "diagram_heavy", "scanned": "scanned"}
#: Category by what a file's name holds, in the order of the rules: (category, parts, whole codes) (fixed values).
CATEGORY_RULES = [
    ("provas", ["prova", "exame"], ["test", "p1", "p2", "p3", "av1", "av2"]),
    ("listas", ["lista", "exerc", "quest", "trab", "exer"], []),
    ("gabaritos", ["gabarito", "resol", "soluc", "key", "espelho"], []),
    ("cronograma", ["cronograma", "plano", "agenda", "schedule", "ementa"], []),
    ("material-de-aula", ["slide", "aula", "apresenta", "unidade", "modulo", "cap"], []),
    ("bibliografia", ["livro", "referencia", "biblio", "artigo", "paper"], []),
    ("trabalhos", ["trabalho", "projeto", "assignment", "enunciado", "spec", "requisito"], []),
]
#: Background colours of schedule rows: kind, and whether the row is ignored (fixed values).
ROW_COLOURS = {"red": ("suspension", True), "#ff0000": ("suspension", True), "lightgrey": ("g2", True), "#d3d3d3": ("g2", True), "#ffa500": ("exam", False), "orange": ("exam", False), "#ff8c00": ("ps", True), "darkorange": ("ps", True), "#8b0000": ("event", True), "darkred": ("event", True), "#ffff00": ("assignment", False), "yellow": ("assignment", False)}
#: Words of schedules that tell nothing of a topic (fixed values).
SCHEDULE_GENERIC = [
    "atividade", "assincrona", "assincrono", "aula", "aulas", "caso", "complementar", "conteudo", "conteudos", "dia", "estudo", "estudos", "exercicio", "exercicios", "gabarito",
    "gabaritos", "hora", "leituras", "lista", "listas", "material", "materia", "pagina", "paginas", "recursos", "recomendadas", "revisao", "revisoes", "resposta", "respostas",
    "semana", "teorica", "teoricas", "pratica", "praticas", "apresentacao", "continuacao", "finalizacao", "prova", "provas", "unidade",
]
#: Phrases of schedule rows that do not teach, that review, that go on with the row before (fixed values).
ADMIN_PHRASES = ["suspensao de aulas", "suspensao das aulas", "suspensao aulas", "suspensao da aula", "suspensao aula", "sem aula", "nao havera aula", "feriado", "recesso", "evento academico", "prova de substituicao", "evento institucional", "devolucao", "entrega de notas", "cancelamento", "aula cancelada", "aula cancelado", "substituicao"]
REVIEW_WORDS = ["revisao", "avaliacao", "prova 1", "prova 2", "prova final", "teste"]
CONTINUATION_WORDS = ["atividade assincrona", "complementar os estudos", "leituras recomendadas", "estudo de caso", "revisao", "exercicio", "exercicios", "lista", "listas", "gabarito", "respostas"]
SOFT_WORDS = ["unidade", "continuacao", "finalizacao", "apresentacao"]
#: Words of units' topics that tell nothing (fixed values).
UNIT_GENERIC = [
    "metodos", "formais", "formal", "logica", "logicas", "especificacao", "especificacoes", "verificacao", "verificacoes", "programas", "programa", "modelos",
    "modelo", "fundamentos", "sistemas", "software", "softwares", "suporte", "propriedades", "aplicacoes", "sequenciais", "concorrentes", "linguagens",
]
#: Words that count little for a unit (fixed values).
UNIT_NEUTRAL = [
    "algoritmo", "algoritmos", "aplicacao", "aplicacoes", "computa", "computacao", "computacoes", "estado", "estados", "fundamentos", "formal", "formais", "logica",
    "logicas", "para", "passo", "passos", "sequencia", "sequencias", "metodos", "modelo", "modelos", "predicado", "predicados", "programa", "programas", "proposicional",
    "substituicao", "simplificacao", "software", "softwares", "suporte", "sistemas", "semantica", "sintaxe", "variavel", "variaveis", "verificacao", "verificacoes",
]
#: Study states (fixed values).
STATUSES = ["pendente", "em_progresso", "compreendido", "revisao"]
#: Words of a course that name tools, general slugs, headings that structure a document, signs of a bibliography, weak
#: beginnings of headings, and words that link a heading to a topic on their own (fixed values).
KNOWN_TOOLS = ["isabelle", "dafny", "coq", "lean", "z3", "nuxmv", "alloy", "tla+", "tla", "nu smv", "nusmv"]
GENERIC_SLUGS = [
    "curso", "conteudo", "conteudos", "arquivo", "pdf", "estudo", "material", "aula", "topicos", "termos", "termo", "disciplina", "estrutura-do-curso", "bibliografia", "avaliacao",
    "ementa", "complementar", "introducao", "formato-de-entrada", "objetivos-de-aprendizagemcompetencias", "procedimentos-metodologicos", "timeline-cronograma-x-unidades",
]
STRUCTURAL_HEADINGS = [
    "como usar", "formato de entrada", "termos", "estrutura do curso", "bibliografia", "avaliacao", "ementa", "conteudos", "conteudo", "complementar", "objetivos de aprendizagemcompetencias",
    "procedimentos metodologicos", "notas do professor", "topicos de alta incidencia em prova", "timeline cronograma x unidades", "revisao", "exercicios",
]
BIBLIOGRAPHY_MARKERS = ["springer", "cambridge", "university press", "undergraduate topics", "lncs", "disponivel", "colecao", "collection", "press", "verlag", "editora", "ed ", "eds "]
WEAK_STARTS = ["seja ", "considere ", "suponha ", "mostre ", "prove ", "resolva ", "um primeiro ", "uma primeira "]
OVERLAP_CUES, WEAK_CUES = ["proposicional", "hoare"], ["recursiv", "indutiv", "predicad", "isabelle", "kripke", "modelo"]
#: Headings that are no topics as a whole, beginnings of goals, endings of goals (fixed values).
WEAK_HEADINGS, GOAL_STARTS, GOAL_ENDS = ["revisao", "exercicios", "atividade assincrona"], ["entender ", "aprender ", "adquirir ", "julgar ", "compreender "], [" software", " sistemas", " programas"]
#: Words around the names of tools, and words that are no tools (fixed values).
TOOL_CONTEXT = ["ferramenta", "solver", "proof assistant", "assistente de prova", "framework", "biblioteca", "library", "parser", "parsers", "linguagem"]
TOOL_STOPWORDS = [
    "curso", "disciplina", "aula", "aulas", "material", "materiais", "conteudo", "conteudos", "introducao", "fundamentos", "teoria", "pratica", "revisao", "exercicios", "atividade",
    "atividades", "lista", "listas", "prova", "provas", "projeto", "projetos", "sistema", "sistemas", "analise", "estudo",
]
#: Cues of review and of exams, and words of formal-methods courses (fixed values).
REVIEW_CUES = ["revisao", "revisao para prova", "revisao de prova", "preparacao para prova", "preparacao de prova", "preparatorio para prova", "simulado"]
EXAM_CUES = ["prova", "exame", "avaliacao", "teste", "p1", "p2", "p3", "pf", "av1", "av2", "n1", "n2"]
FORMAL_WORDS = ["metodos formais", "formal methods", "isabelle", "coq", "lean", "dafny", "theorem prover", "provadores de teoremas", "tla", "alloy", "nusmv", "nuxmv"]
#: Type tags by a part of the category, in order (fixed values).
TYPE_TAGS = [("listas", "tipo:lista"), ("gabaritos", "tipo:gabarito"), ("provas", "tipo:prova"), ("material de aula", "tipo:material-base"), ("codigo professor", "tipo:codigo"), ("codigo aluno", "tipo:codigo")]
