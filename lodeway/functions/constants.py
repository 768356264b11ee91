"""Vocabulary of the code knowledge graph. All are fixed values."""

# Entity types.
ENTITY_TYPES = (
    "class function method import module interface component hook type enum selector style template config variable symbol "
    "property constant service directive pipe controller endpoint doc"
).split()

# Labels that stand for an entity type, by type.
TYPE_ALIASES_BY_TYPE = {
    "function": "fn func procedure subroutine lambda closure callback generator coroutine decorator handler helper util utility "
    "validator test test_case spec macro",
    "class": "struct structure dataclass record model exception mixin",
    "interface": "protocol trait abstract_class",
    "type": "type_alias typedef typealias dto schema union",
    "enum": "enumeration enum_class",
    "constant": "const define literal",
    "variable": "var field attribute member global signal state store",
    "property": "prop getter setter accessor",
    "endpoint": "route api api_endpoint rest_endpoint url websocket channel topic queue event",
    "module": "mod package namespace file script library",
    "component": "widget view page screen fragment element",
    "service": "provider repository dao manager client gateway middleware guard interceptor resolver worker job scheduler",
    "style": "stylesheet css scss css_class",
    "template": "markup layout partial",
    "config": "configuration settings setting env environment manifest option cfg conf",
    "doc": "documentation docs readme markdown guide docstring",
    "hook": "composable",
    "import": "dependency require include",
}
TYPE_ALIASES = {alias: kind for kind, names in TYPE_ALIASES_BY_TYPE.items() for alias in names.split()}

# Relation types.
RELATION_TYPES = "defines calls imports inherits uses instantiates".split()
#: Order of the relation digest.
DIGEST_ORDER = "instantiates calls inherits uses imports defines".split()
REFERENCES = "calls uses instantiates inherits".split()

# Definition types, by operator.
CLONE_TYPES = "class function method component interface enum type hook".split()
DEAD_TYPES = COVERAGE_TYPES = EXPLAIN_TYPES = "function method class component interface".split()
MAP_TYPES = "class function method component interface module enum".split()
VIEW_TYPES = "class function method component interface enum type module".split()

# Suffixes of indexable file names.
CODE_SUFFIXES = (
    ".py .pyi .js .mjs .cjs .jsx .ts .mts .cts .tsx .vue .svelte .astro .java .kt .kts .scala .sc .groovy .gradle .go .rs .swift "
    ".dart .zig .d .c .h .cpp .cc .cxx .c++ .hpp .hh .hxx .m .mm .cu .cuh .asm .s .inc .cs .fs .vb .php .phtml .rb .lua .pl .pm "
    ".perl .sh .bash .zsh .fish .ps1 .psm1 .psd1 .ex .exs .erl .hrl .hs .lhs .clj .cljs .cljc .edn .r .jl .sql .graphql .gql "
    ".proto .prisma .nim .nims .ml .mli .html .htm .css .scss .sass .less .jinja .jinja2 .j2 .njk .hbs .ejs .yaml .yml .toml .json "
    ".env .tf .tfvars .hcl .nix .sol .md .markdown .tex .rst .v .sv .vhdl .vhd .f .f90 .f95 .gd .gdshader .gdshaderinc .godot .cfg"
).split()
NAMED_FILES = (
    ".env.example .env.sample .env.local .env.test .env.development .env.production .gitignore .gitattributes .gitmodules "
    ".dockerignore .npmrc .nvmrc .yarnrc .prettierrc .prettierignore .editorconfig .eslintrc .eslintignore .stylelintrc .babelrc "
    ".browserslistrc dockerfile makefile justfile rakefile gemfile procfile jenkinsfile vagrantfile cmakelists.txt pre-commit "
    "pre-push commit-msg post-merge post-checkout"
).split()
#: Suffixes by which an entity's name is read as another file.
FILE_SUFFIXES = [*CODE_SUFFIXES, *".iss .nsi .spec .lock .ini .txt".split()]

# Directories that are not indexed.
IGNORED_DIRS = (
    "venv .venv env .env __pycache__ .pytest_cache .mypy_cache .ruff_cache site-packages .eggs *.egg-info node_modules .npm .yarn "
    ".pnp dist build out output .next .nuxt .svelte-kit target bin obj release debug .git .svn .hg .idea .vscode .vs .zcode "
    ".ux-audit logs log tmp temp .cache .tmp .gradle vendor cmakefiles coverage .coverage htmlcoverage .tox buck-out .angular "
    ".godot .import addons _"
).split()
SECRET_NAMES = ".env .pem .key .pfx .p12 id_rsa id_ed25519 credentials secrets".split()
MAX_FILE_BYTES, MIN_CHARS = 5 * 1024 * 1024, 50

# Words of template expressions that name nothing.
TEMPLATE_LITERALS = "true false null undefined this void let as of in track else if switch case default empty".split()
TEMPLATE_LOCALS = (
    "for defer placeholder loading error prefetch when on idle viewport interaction hover immediate timer index first last even odd count"
).split()

# Methods and files that a framework calls.
FRAMEWORK_METHODS = (
    "ngOnInit ngOnDestroy ngOnChanges ngDoCheck ngAfterContentInit ngAfterContentChecked ngAfterViewInit ngAfterViewChecked transform "
    "resolve intercept canActivate canActivateChild canDeactivate canLoad canMatch writeValue registerOnChange registerOnTouched "
    "setDisabledState validate ngDoBootstrap"
).split()
FRAMEWORK_FILES = ".component.ts .pipe.ts .guard.ts .interceptor.ts .resolver.ts .directive.ts .module.ts".split()

# Names of test files for the coverage operator.
TEST_GLOBS = (
    "test_*.py *_test.py **/tests/** **/test/** **/conftest.py *.test.js *.test.jsx *.test.ts *.test.tsx *.spec.js *.spec.jsx "
    "*.spec.ts *.spec.tsx **/__tests__/** **/spec/** *_test.go *Test.java *Tests.java *Test.kt *Tests.kt **/benches/**"
).split()
#: And for the dead-code operator.
TEST_FILE = r"(?i)(^|/)(tests?|__tests__)/|(^|/)test_[^/]+$|[._-](test|spec)\.[a-z]+$|_test\.[a-z]+$"

# Language of a suffix.
LANGUAGES = {
    "python": ".py", "js": ".js .jsx .mjs .cjs", "ts": ".ts .tsx", "go": ".go", "rust": ".rs", "java": ".java", "cs": ".cs",
    "kotlin": ".kt .kts", "swift": ".swift", "scala": ".scala", "ruby": ".rb", "php": ".php", "cpp": ".cpp .cc .cxx .hpp .hh .h",
    "c": ".c", "lua": ".lua", "dart": ".dart",
}

# Patterns of the traits of each language, in Java's syntax.
TRAITS = {
    "python": {
        "async": [r"\basync\s+def\b"],
        "generator": [r"\byield\b"],
        "abstract": [r"@abstractmethod\b|@abstractclassmethod\b|@abstractproperty\b", r"\bclass\s+\w+\s*\(\s*[A-Za-z_.]*ABC[A-Za-z_.]*\s*[,)]"],
        "static": [r"@staticmethod\b|@classmethod\b"],
    },
    "js": {
        "async": [r"\basync\s+(?:function|\([^)]*\)|[A-Za-z_$][\w$]*\s*=)"],
        "generator": [r"\bfunction\s*\*", r"^\s*\*\s*\w+\s*\(", r"\byield\b"],
        "exported": [r"\bexport(?:\s+default)?\b"],
        "default-export": [r"\bexport\s+default\b"],
        "static": [r"(?m)^\s*static\s+"],
    },
    "ts": {
        "async": [r"\basync\s+(?:function|\([^)]*\)|[A-Za-z_$][\w$]*\s*=)"],
        "generator": [r"\bfunction\s*\*", r"^\s*\*\s*\w+\s*\(", r"\byield\b"],
        "abstract": [r"\babstract\s+class\b", r"(?m)^\s*(?:public\s+|private\s+|protected\s+)?abstract\s+\w+"],
        "exported": [r"\bexport(?:\s+default)?\b"],
        "default-export": [r"\bexport\s+default\b"],
        "static": [r"(?m)^\s*static\s+"],
        "input": [r"@Input\b", r"=\s*input(?:\.required)?\s*[<(]", r"=\s*model(?:\.required)?\s*[<(]"],
        "output": [r"@Output\b", r"=\s*output\s*[<(]"],
        "signal": [r"=\s*(?:signal|output|computed)\s*[<(]", r"=\s*(?:input|model)(?:\.required)?\s*[<(]"],
        "computed": [r"=\s*computed\s*[<(]"],
        "effect": [r"\beffect\s*\("],
        "viewchild": [r"@(?:ViewChild|ViewChildren|ContentChild|ContentChildren)\b", r"=\s*(?:viewChild|contentChild)(?:\.required)?\s*[<(]"],
        "injected": [r"=\s*inject\s*\("],
    },
    "rust": {
        "async": [r"\basync\s+fn\b"],
        "exported": [
            r"\bpub(?:\s*\([^)]+\))?\s+(?:(?:async|unsafe|const|extern\s*(?:\"[^\"]*\")?)\s+)*"
            r"(?:fn|struct|trait|enum|mod|const|static|unsafe|type|impl|use)\b"
        ],
        "abstract": [r"\btrait\s+\w+"],
    },
    "java": {
        "abstract": [r"\babstract\s+(?:class|interface)\b", r"(?m)^\s*(?:public|protected|private)?\s*abstract\s+"],
        "static": [r"(?m)^\s*(?:public|protected|private)?\s*(?:final\s+)?static\s+"],
        "exported": [r"(?m)^\s*public\s+"],
    },
    "cs": {
        "async": [r"\basync\s+(?:[A-Za-z<>\[\],\s.]+\s+)?\w+\s*\("],
        "abstract": [r"\babstract\s+(?:class|interface)\b", r"(?m)^\s*(?:public|protected|private|internal)?\s*abstract\s+"],
        "static": [r"(?m)^\s*(?:public|protected|private|internal)?\s*static\s+"],
        "exported": [r"(?m)^\s*public\s+"],
    },
    "kotlin": {
        "async": [r"\bsuspend\s+fun\b"],
        "abstract": [r"\babstract\s+(?:class|fun|val|var)\b"],
        "exported": [r"(?m)^\s*public\s+"],
        "static": [r"@JvmStatic\b"],  # a word boundary before the sign would never match
    },
    "swift": {
        "async": [r"\basync\s+func\b", r"\bfunc\s+\w+\s*\([^)]*\)\s*(?:throws\s+)?async\b"],
        "static": [r"\bstatic\s+(?:func|var|let)\b", r"\bclass\s+(?:func|var)\b"],
        "exported": [r"(?m)^\s*(?:public|open)\s+"],
    },
    "scala": {
        "abstract": [r"\babstract\s+class\b", r"(?m)^\s*trait\s+"],
        "exported": [r"(?m)^\s*(?:public)?\s*(?:def|val|var|class|object|trait)\s+(?!_)\w"],
    },
    "ruby": {"generator": [r"\byield\b"]},
    "php": {
        "generator": [r"\byield\b"],
        "abstract": [r"\babstract\s+(?:class|function)\b"],
        "static": [r"\bstatic\s+function\b"],
        "exported": [r"\bpublic\s+function\b"],
    },
    "cpp": {"abstract": [r"=\s*0\s*;"], "static": [r"(?m)^\s*static\s+"], "exported": [r"(?m)^\s*export\s+"]},
    "c": {"static": [r"(?m)^\s*static\s+"], "exported": [r"(?m)^\s*extern\s+"]},
    "lua": {"exported": [r"(?m)^\s*function\s+\w+[.:]\w+"]},
    "dart": {
        "async": [r"\basync\s*(?:\*)?\s*\{"],
        "generator": [r"\)\s*async\*\s*\{", r"\)\s*sync\*\s*\{"],
        "abstract": [r"\babstract\s+class\b"],
        "static": [r"(?m)^\s*static\s+"],
    },
}
# Marks of deprecated code and of tests, and what declares a name.
DEPRECATED = r"(?i)@deprecated\b|\bDEPRECATED\b|#\[deprecated\b|\[Obsolete\b|@available\([^)]*deprecated"
TEST_BASENAME = (
    r"^(test_|conftest)|(_test\.py|_test\.go|tests?\.java|tests?\.kt|tests?\.scala|test\.rb|_spec\.rb|tests?\.cs)$|\.test\.|\.spec\."
)
TEST_FOLDER = r"/(tests|test|__tests__|spec|specs)/"
DECLARING = "def class function interface type enum fn func const let var".split()
COMMENT_MARKS = ["#", "//", "/*", "*", "<!--", '"""', "'''"]
# What code search takes, and leaves out.
SEARCH_SUFFIXES = (
    ".py .pyi .ipynb .js .jsx .ts .tsx .vue .java .kt .scala .groovy .go .rs .swift .dart .cs .fs .vb .php .rb .pl .pm "
    ".cpp .cc .cxx .h .hpp .c .m .mm .sql .sh .bash .yaml .yml .toml .json .xml .html .css .scss .less"
).split()
SEARCH_DROPPED = ".min.js .min.css .map .pyc .class .jar".split()
SEARCH_IGNORED = (
    "node_modules venv .venv __pycache__ .git .pytest_cache dist build logs .idea .vscode target bin obj .gradle vendor CMakeFiles "
    "Debug Release .angular"
).split()
