"""The languages of problem 3: how their texts are cut into tokens, and their grammars in the notation of ``peg``."""

from __future__ import annotations

import re

from .peg import FIRST, KEPT, SPAN, TABLE, Grammar, Kinds


def _kinds(words: str, marks: str) -> dict[str, str]:
    """A character for each keyword and mark."""
    kinds = {w: chr(0xE100 + n) for n, w in enumerate(words.split())}
    kinds |= {m: m if len(m) == 1 else chr(0xE800 + n) for n, m in enumerate(marks.split())}
    return kinds | {"\n": "\n", "\x01": "\x01"}


IDENT, NUMBER, STRING, TEMPLATE, REGEX, BAD = "i", "n", "s", "t", "r", "\x00"

# ---------------------------------------------------------------------------------------------- TypeScript, JavaScript
# fixed values: the words and marks of the languages
ES_RESERVED = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with"
ES_CONTEXT = "abstract accessor as assert asserts async await declare from get global implements infer interface is keyof let module namespace of out override package private protected public readonly satisfies set static type unique yield"
ES_MARKS = "{ } ( ) [ ] ; , < > <= >= == != === !== + - * / % ** ++ -- << & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= => . ... @"

ES = """
Program <- Items !.
ItemsX <- Sep* (Item Sep*)* '\x01' !.
Items <- Sep* (Item Sep*)*
Stmts <- StmtList !.
StmtsX <- StmtList '\x01' !.
StmtList <- Sep* (Stmt Sep*)*
Sep <- ';' / NL
End <- ';' / NL / !.
Id <- IDENT / CONTEXT
Name <- IDENT / CONTEXT / RESERVED
Item <- Import / Export / Stmt
Import <- 'import' STRING Attr? End / 'import' ImportClause 'from' STRING Attr? End / TS_ 'import' 'type' ImportClause 'from' STRING Attr? End
    / TS_ 'import' Id '=' Postfix End
ImportClause <- Id (',' (NsImport / @names))? / NsImport / @names
NsImport <- '*' 'as' Id
Names <- (ModName (',' ModName)* ','?)? !.
ModName <- (Name / STRING) ('as' (Name / STRING))? &(',' / !.) / TS_ 'type' Name ('as' Name)?
Attr <- ('with' / 'assert') @obj
Export <- Decorator* 'export' ('*' ('as' (Name / STRING))? 'from' STRING Attr? End / (TS_ 'type')? @names ('from' STRING Attr?)? End
    / 'default' (FuncDecl / ClassDecl / TS_ InterfaceDecl / Assign End) / TS_ '=' Expr End / TS_ 'import' Id '=' Postfix End / TS_ 'as' 'namespace' Id End / VarStmt / FuncDecl / ClassDecl / TsDecl)
Decorator <- '@' (Name ('.' Name)* @args? / @expr) NL?
Stmt <- @block / VarStmt / FuncDecl / ClassDecl / TsDecl
    / 'if' @expr NL? Stmt (NL? 'else' NL? Stmt)?
    / 'for' 'await'? @forh NL? Stmt
    / 'while' @expr NL? Stmt
    / 'do' NL? Stmt NL? 'while' @expr End?
    / 'return' Expr? End / 'throw' Expr End / ('break' / 'continue') Id? End
    / 'try' NL? @block NL? (Catch (NL? Finally)? / Finally)
    / 'switch' @expr NL? @switch
    / 'debugger' End / ';' / Id ':' NL? Stmt / !NOEXPR Expr End
Catch <- 'catch' @params? NL? @block
Finally <- 'finally' NL? @block
Switch <- Sep* (('case' Expr / 'default') ':' CaseItems)* !.
CaseItems <- Sep* (!('case' / 'default' ':') Stmt Sep*)*
VarStmt <- VAR Binding (',' Binding)* End
Binding <- Pattern (TS_ '!')? Ann? ('=' Assign)?
Pattern <- Id / @objpat / @arrpat
ObjPat <- (PatProp (',' PatProp)* ','?)? !.
PatProp <- '...' Pattern / Key ':' PatTarget ('=' Assign)? / Id ('=' Assign)?
PatTarget <- Pattern / Postfix
ArrPat <- ','* (('...' PatTarget / PatTarget ('=' Assign)?) (','+ ('...' PatTarget / PatTarget ('=' Assign)?))*)? ','* !.
FuncDecl <- 'async'? 'function' '*'? Id? TypeParams? @params Ret? (NL? @block / TS_ End)
ClassDecl <- Decorator* (TS_ 'abstract')? 'class' (!('extends' / 'implements') Id)? TypeParams? ('extends' Postfix TypeArgs?)? (TS_ 'implements' Type (',' Type)*)? NL? @class
Class <- ClassList !.
ClassX <- ClassList '\x01' !.
ClassList <- Sep* (Member Sep*)*
Member <- 'static' @block / Decorator* Mod* (TS_ @idxsig Ann End / '*'? Key (Method / Field))
Mod <- MODIFIER !NL &KeyStart
KeyStart <- Name / STRING / NUMBER / @index / '*' / BRACKET
Key <- Name / STRING / NUMBER / @index
Method <- (TS_ '?')? TypeParams? @params Ret? (NL? @block / TS_ End)
Field <- (TS_ ('?' / '!'))? Ann? ('=' Assign)? End
Obj <- (Prop (',' Prop)* ','?)? !.
Prop <- '...' Assign / ('get' / 'set') &KeyStart Key @params Ret? @block / ('async' &KeyStart)? '*'? Key TypeParams? @params Ret? @block / Key ':' Assign / Id ('=' Assign)?
Params <- (Param (',' Param)* ','?)? !.
Param <- Decorator* (TS_ MODIFIER &(Id / BRACE / BRACKET))* (TS_ 'this' / '...'? Pattern) (TS_ '?')? Ann? ('=' Assign)?
Args <- (Arg (',' Arg)* ','?)? !.
Arg <- '...'? Assign
Whole <- Expr !.
ForHead <- VAR? Pattern ('of' Assign / 'in' Expr) !. / !VAR Postfix ('of' Assign / 'in' Expr) !. / (VAR Binding (',' Binding)* / Expr)? ';' Expr? ';' Expr? !.
Arr <- ','* (Arg (','+ Arg)*)? ','* !.
Expr <- Assign (',' Assign)*
Assign <- Arrow / 'yield' '*'? Assign? / Cond (ASSIGN Assign)?
Arrow <- 'async'? Id '=>' Body / 'async'? TypeParams? @params Ret? '=>' Body
Body <- @block / !BRACE Assign
Cond <- Bin ('?' Assign ':' Assign)?
Bin <- Unary (Op Unary / TS_ ('as' / 'satisfies') Type)*
Op <- '>' '>'? '>'? / BINARY
Unary <- UNARY Unary / TS_ TypeArgs Unary / Postfix
Postfix <- TEMPLATE !TEMPLATE Tail* / !TEMPLATE Primary Tail* ('++' / '--')?
Tail <- '.' Name / '?.' (Name / @args / @index) / @args / @index / TEMPLATE / TS_ '!' / TS_ TypeArgs (@args / TEMPLATE)
Primary <- 'async'? 'function' '*'? Id? TypeParams? @params Ret? @block / ClassDecl / 'new' ('.' IDENT / NewTarget TypeArgs? @args?) / 'import' (@args / '.' Name)
    / 'super' / LITERAL / Id / @expr / @arr / @obj / @objpat / @arrpat
NewTarget <- ('new' NewTarget @args? / Primary) ('.' Name / @index)*
Ann <- TS_ ':' Type
Ret <- TS_ ':' ('asserts'? (Id / 'this') 'is' Type / 'asserts' (Id / 'this') / Type)
Type <- 'abstract'? 'new'? TypeParams? @params '=>' (Id 'is' Type / Type) / CondType
CondType <- UnionType ('extends' UnionType '?' Type ':' Type)?
UnionType <- ('|' / '&')? PostType (('|' / '&') PostType)*
PostType <- (('keyof' / 'unique' / 'readonly' / 'infer') &TypeStart)* PrimType @typeidx*
TypeStart <- Name / STRING / BRACKET / BRACE / @ptype
PrimType <- @ptype / @iface / @tuple / 'typeof' ('import' @args)? QName? TypeArgs? / 'import' @args ('.' Name)* TypeArgs? / STRING / '-'? NUMBER / TEMPLATE / QName TypeArgs?
QName <- Name ('.' Name)*
TypeArgs <- '<' Type (',' Type)* ','? '>'
TypeParams <- TS_ '<' TypeParam (',' TypeParam)* ','? '>'
TypeParam <- ('const' / 'in' / 'out')* Id ('extends' Type)? ('=' Type)?
PType <- Type !.
TypeIdx <- Type? !.
Tuple <- (TupleEl (',' TupleEl)* ','?)? !.
TupleEl <- '...'? Name '?'? ':' Type / '...'? Type '?'?
IdxSig <- Id ':' Type !. / Id 'in' Type ('as' Type)? !.
Iface <- IfaceSep* (TMember (IfaceSep+ / !.))* !.
IfaceSep <- ';' / ',' / NL
TMember <- (('+' / '-')? 'readonly')? @idxsig (('+' / '-')? '?')? Ann? / (('readonly' / 'get' / 'set') &KeyStart)? Key '?'? (TypeParams? @params Ret? / Ann?) / 'new'? TypeParams? @params Ret?
InterfaceDecl <- 'interface' Id TypeParams? ('extends' Type (',' Type)*)? NL? @iface
TsDecl <- TS_ (InterfaceDecl / 'type' Id TypeParams? '=' Type End / 'const'? 'enum' Id NL? @enum / ('namespace' / 'module') (QName / STRING) (NL? @module / End) / 'global' @module
    / 'declare' (VarStmt / FuncDecl / ClassDecl / TsDecl))
Enum <- (Key ('=' Assign)? (',' Key ('=' Assign)?)* ','?)? !.
"""

_ES_SKIP = r"(?:[^\S\n\r  ]+|//[^\n\r]*|/\*(?:[^*]|\*(?!/))*\*/|﻿)*"
_ES_REGEX = r"/(?![/*])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*"
_ES_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`'\"]|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\[\s\S])*`|\{(?:[^{}`]|\{[^{}`]*\})*\})*\})*`"
_ES_IDENT = r"#?(?:[^\W\d]|\$|\\u[0-9A-Fa-f]{4})[\w$\u200c\u200d]*"
ES_TOKEN = re.compile(
    _ES_SKIP
    + r"((?:[\n\r  ]"
    + _ES_SKIP
    + r")+|(?:[(,=:\[!&|?{};+\-*%<>~^]|\breturn|\btypeof|\bcase|\bin|\bof)[ \t]*(?:[\n\r][ \t]*)?"
    + _ES_REGEX
    + rf"|{_ES_IDENT}|(?:0[xX][\dA-Fa-f_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)n?(?![A-Za-z0-9_$])"
    + r"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|"
    + _ES_TEMPLATE
    + r"|\.\.\.|=>|\?\.(?!\d)|&&=|\|\|=|\?\?=|\*\*=|<<=|>>>=|>>=|===|!==|\*\*|\+\+|--|&&|\|\||\?\?|<<|<=|>=|==|!=|[-+*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@]|\Z|[\s\S])"
)
_ES_NUMBER = re.compile(r"\.?\d")


class Language:
    """A grammar with its tokens."""

    def __init__(self, grammar: Grammar, kinds: Kinds, token: re.Pattern, start: str, tidy) -> None:
        self.grammar, self.kinds, self.token, self.start, self.tidy = grammar, kinds, token, start, tidy

    def flat(self, text: str) -> str:
        return self.tidy("".join(map(self.kinds.__getitem__, self.token.findall(text))))

    def valid(self, text: str) -> bool:
        return self.grammar.parse(self.start, self.grammar.reduce(self.flat(text))) < 0


def _es(ts: bool) -> Language:
    kinds = _kinds(f"{ES_RESERVED} {ES_CONTEXT}", ES_MARKS)
    of = lambda words: "".join(kinds[w] for w in words.split())
    classes = {
        "IDENT": IDENT, "NUMBER": NUMBER, "STRING": STRING, "TEMPLATE": TEMPLATE, "NL": "\n", "CONTEXT": of(ES_CONTEXT), "RESERVED": of(ES_RESERVED),
        "LITERAL": NUMBER + STRING + TEMPLATE + REGEX + of("this null true false"), "VAR": of("const let var"),
        "NOEXPR": of("function class else case catch finally export"), "ASSIGN": of("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??="),
        "BINARY": of("+ - * / % ** & | ^ && || ?? == != === !== < <= >= << in instanceof"), "UNARY": of("+ - ! ~ typeof void delete await ++ --"),
        "MODIFIER": of("public private protected readonly static abstract override declare accessor async get set" if ts else "static async get set accessor"),
        "BRACE": "", "BRACKET": "",
    }
    classes["BRACKET"] = "".join(chr(FIRST + SPAN + n) for n in range(SPAN))
    classes["BRACE"] = "".join(chr(FIRST + 2 * SPAN + n) for n in range(SPAN))
    readings = {
        "(": {"args": "Args", "params": "Params", "expr": "Whole", "forh": "ForHead", "ptype": "PType"},
        "[": {"arr": "Arr", "arrpat": "ArrPat", "index": "Whole", "tuple": "Tuple", "typeidx": "TypeIdx", "idxsig": "IdxSig"},
        "{": {"block": "Stmts", "obj": "Obj", "objpat": "ObjPat", "class": "Class", "iface": "Iface", "names": "Names", "switch": "Switch", "enum": "Enum", "module": "Program"},
    }
    text = ES
    if ts:
        text = text.replace("TS_ ", "")
    else:  # what only TypeScript has can't match
        text = text.replace("TS_ ", "NEVER ")
        classes["NEVER"] = ""
        for b, rs in {"(": ["ptype"], "[": ["tuple", "typeidx", "idxsig"], "{": ["iface", "enum"]}.items():
            for r in rs:
                readings[b][r] = "Nothing"
        text += "\nNothing <- NEVER\n"
    lists = {"Program": "ItemsX", "Stmts": "StmtsX", "Class": "ClassX"}
    g = Grammar(text, kinds, classes, readings, lists, _items(of("else catch finally while from , . = ? : + - * / && || ?? === !== == != < > => as"), ";\n"))

    def classify(t: str) -> str:
        c = t[:1]
        if not c:
            return ""
        if c in "\n\r  ":
            return "\n"
        if len(t) > 1:
            if c in "'\"":
                return STRING
            if c == "`":
                return TEMPLATE
            if _ES_NUMBER.match(t):
                return NUMBER
            i = t.find("/")
            if i > 0 and t not in kinds:
                return classify_known(t[:i].strip()) + REGEX
            if re.fullmatch(_ES_IDENT, t):
                return IDENT
            return BAD
        if c.isdigit():
            return NUMBER
        return IDENT if c == "_" or c == "$" or c.isalpha() else BAD

    def classify_known(t: str) -> str:
        return kinds.get(t) or classify(t)

    ends = IDENT + NUMBER + STRING + TEMPLATE + REGEX + ")]}" + of(f"{ES_CONTEXT} this null true false super return break continue throw ++ --")
    starts = IDENT + NUMBER + STRING + "{@!~[" + "".join(kinds[w] for w in f"{ES_RESERVED} {ES_CONTEXT}".split() if w not in ("in", "instanceof", "as", "satisfies", "extends", "implements", "from")) + of("++ -- ...")
    keep = re.compile(rf"(?<![{re.escape(ends)}])\n|\n(?![{re.escape(starts)}])")
    # a bracket on a new line opens a member's name in a class but an index in a statement
    return Language(g, Kinds(kinds, classify), ES_TOKEN, "Program", lambda s: keep.sub("", s) if "\n" in s else s)



def _items(goes_on: str, ends: str) -> re.Pattern:
    """Items of a list of statements: up to an end mark, or a brace pair that nothing goes on after."""
    brace = f"{chr(FIRST + 2 * SPAN)}-{chr(FIRST + 3 * SPAN - 1)}"
    other = f"{chr(FIRST)}-{chr(FIRST + 2 * SPAN - 1)}"
    e, c = re.escape(ends), re.escape(goes_on)
    return re.compile(rf"[^{e}{brace}]*(?:[{e}]+|[{brace}](?:[{c}{other}{e}]*[{c}{other}][^{e}{brace}]*(?:[{brace}]|[{e}]+))*[{e}]*)|[\s\S]+")


# ------------------------------------------------------------------------------------------------------------- Java
# fixed values: the words and marks of the language
JAVA_RESERVED = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null"
JAVA_CONTEXT = "record sealed permits non-sealed yield var module open when"
JAVA_MARKS = "{ } ( ) [ ] ; , . ... @ :: -> < > <= >= == != && || ! ~ ? : + - * / % & | ^ << ++ -- = += -= *= /= %= &= |= ^= <<= >>= >>>="

JAVA = """
Program <- Annot* ('package' QName ';')? (';' / 'import' 'static'? QName ('.' '*')? ';')* TypeList !.
Members <- TypeList !.
MembersX <- TypeList '\x01' !.
Class <- MemberList !.
ClassX <- MemberList '\x01' !.
Stmts <- StmtList !.
StmtsX <- StmtList '\x01' !.
TypeList <- (';' / TypeDecl)*
MemberList <- (';' / Member)*
StmtList <- Stmt*
Id <- IDENT / CONTEXT
QName <- Id ('.' Id)*
Annot <- '@' !'interface' QName @annargs?
AnnArgs <- (AnnArg (',' AnnArg)* ','?)? !.
AnnArg <- Id '=' AnnVal / AnnVal
AnnVal <- Annot / @init / Cond
Mods <- (Annot / MODIFIER)*
TypeDecl <- Mods (ClassDecl / InterfaceDecl / EnumDecl / RecordDecl / AnnotDecl / Method)
ClassDecl <- 'class' Id TypeParams? ('extends' Type)? ('implements' Type (',' Type)*)? ('permits' Type (',' Type)*)? @class
InterfaceDecl <- 'interface' Id TypeParams? ('extends' Type (',' Type)*)? ('permits' Type (',' Type)*)? @class
EnumDecl <- 'enum' Id ('implements' Type (',' Type)*)? @enum
RecordDecl <- 'record' Id TypeParams? @params ('implements' Type (',' Type)*)? @class
AnnotDecl <- '@' 'interface' Id @class
Enum <- (EnumConst (',' EnumConst)* ','?)? (';' MemberList)? !.
EnumConst <- Annot* Id @args? @class?
Member <- 'static'? @block / Mods (ClassDecl / InterfaceDecl / EnumDecl / RecordDecl &. / AnnotDecl / Method / Field)
Method <- TypeParams? (Type Id / Id) @params Dims? ('throws' Type (',' Type)*)? (@block / 'default' AnnVal ';' / ';') / Id @block
Field <- Type Declarator (',' Declarator)* ';'
Declarator <- Id Dims? ('=' (@init / Expr))?
Dims <- (Annot* @dim)+
Dim <- !.
Init <- ((@init / Expr / Annot) (',' (@init / Expr / Annot))* ','?)? !.
Params <- (Param (',' Param)* ','?)? !.
Param <- Mods Type (Annot* '...')? ((Id '.')* 'this' / Id Dims?)
Type <- Annot* (PRIMITIVE / ClassType) Dims?
ClassType <- Id TypeArgs? ('.' Annot* Id TypeArgs?)*
TypeArgs <- '<' (TypeArg (',' TypeArg)*)? '>'
TypeArg <- Annot* '?' (('extends' / 'super') Type ('&' Type)*)? / Type
TypeParams <- '<' TypeParam (',' TypeParam)* '>'
TypeParam <- Annot* Id ('extends' Type ('&' Type)*)?
Stmt <- @block / ';' / 'if' @expr Stmt ('else' Stmt)? / 'while' @expr Stmt / 'do' Stmt 'while' @expr ';' / 'for' @forh Stmt
    / 'try' @resources? @block (Catch* Finally / Catch+ / &.)? / 'switch' @expr @switch / 'synchronized' @expr @block
    / 'return' Expr? ';' / 'throw' Expr ';' / 'break' Id? ';' / 'continue' Id? ';' / 'yield' Expr ';' / 'assert' Expr (':' Expr)? ';'
    / Mods (ClassDecl / InterfaceDecl / EnumDecl / RecordDecl) / Id ':' Stmt / LocalVar ';' / !NOEXPR !(Bare ';') Expr ';' / ('this' / 'super') @args ';'
Bare <- LITERAL / ('this' / Id) ('.' Id)*
LocalVar <- Mods Type Declarator (',' Declarator)*
Catch <- 'catch' @catch @block
CatchHead <- Mods Type ('|' Type)* Id !.
Finally <- 'finally' @block
Resources <- (LocalVar / Expr) (';' (LocalVar / Expr))* ';'? !.
ForHead <- Mods Type Id ':' Expr !. / (LocalVar / Expr (',' Expr)*)? ';' Expr? ';' (Expr (',' Expr)*)? !.
Switch <- (SwitchLabel (':' / '->') (&('case' / 'default') / !. / StmtList1))* !.
StmtList1 <- (!('case' / 'default' (':' / '->')) (Stmt / Expr ';'))*
SwitchLabel <- 'case' CaseItem (',' CaseItem)* ('when' Cond)? / 'default'
CaseItem <- 'default' / Type Id / Type @args / Cond
Args <- (Expr (',' Expr)*)? !.
Whole <- Expr !.
Cast <- Type ('&' Type)* !.
Lambda <- (Id / @params / @ids) '->' (@block / Expr)
Ids <- (Id (',' Id)*)? !.
Expr <- Lambda / Cond (ASSIGN (@init / Expr))?
Cond <- Bin ('?' Expr ':' (Lambda / Cond))?
Bin <- Unary (Op Unary / 'instanceof' 'final'? (Type Id / Type @args / Type))*
Op <- '>' '>'? '>'? / BINARY
Unary <- UNARY Unary / @cast &CASTABLE (Lambda / Unary) / @castp Unary / Postfix
CastP <- PRIMITIVE Dims? !.
Postfix <- Primary Tail* ('++' / '--')*
Tail <- '.' 'new' ClassType @args @class? / '.' (TypeArgs? ('super' / 'this' / 'class' / Id) &. / TypeArgs? Id / 'class' / 'this' / 'super') / @args / @index / @dim / '::' TypeArgs? (Id / 'new') / TypeArgs &('::' / @args) / TypeArgs @dim* '::' (Id / 'new')
Primary <- 'new' Annot* TypeArgs? (PRIMITIVE / ClassType) (@args @class? / (@index / @dim)+ @init?) / 'switch' @expr @switch / LITERAL / 'this' / 'super' / PRIMITIVE Dims? ('.' 'class' / '::' 'new')
    / 'void' '.' 'class' / ClassType Dims? '::' (Id / 'new') / ClassType Dims '.' 'class' / Id / @expr
"""
_C_SKIP = r"(?:\s+|//[^\n\r]*|/\*(?:[^*]|\*(?!/))*\*/|﻿)*"
JAVA_TOKEN = re.compile(
    _C_SKIP
    + r"(non-sealed(?!\w)|[^\W\d]\w*(?:\$\w*)*|\$[\w$]*|(?:0[xX][\dA-Fa-f_]+|0[bB][01_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)[lLfFdD]?(?![A-Za-z0-9_$])"
    + r'|"""[ \t\f]*[\r\n](?:[^"\\]|\\[\s\S]|"(?!""))*"""|"(?:[^"\\\n\r]|\\[^\n\r])*"|\'(?:[^\'\\\n\r]|\\(?:u+[0-9A-Fa-f]{4}|[0-7]{1,3}|[^\n\r]))[\udc00-\udfff]?\''
    + r"|\.\.\.|::|->|<<=|>>>=|>>=|\+\+|--|&&|\|\||<<|<=|>=|==|!=|[-+*/%&|^]=|[{}()\[\];,.@<>=!~?:+\-*/%&|^]|\Z|[\s\S])"
)


def _java() -> Language:
    kinds = _kinds(f"{JAVA_RESERVED} {JAVA_CONTEXT}", JAVA_MARKS)
    of = lambda words: "".join(kinds[w] for w in words.split())
    classes = {
        "IDENT": IDENT, "CONTEXT": of(JAVA_CONTEXT), "LITERAL": NUMBER + STRING + of("true false null"),
        "MODIFIER": of("public private protected static abstract final native synchronized transient volatile strictfp default sealed non-sealed"),
        "PRIMITIVE": of("boolean byte char double float int long short void var"), "ASSIGN": of("= += -= *= /= %= &= |= ^= <<= >>= >>>="),
        "BINARY": of("+ - * / % & | ^ && || == != < <= >= <<"), "UNARY": of("+ - ! ~ ++ --"), "NOEXPR": of("class else case catch finally"),
        "CASTABLE": IDENT + NUMBER + STRING + of(f"{JAVA_CONTEXT} this super new true false null ! ~ switch") + "".join(chr(FIRST + n) for n in range(SPAN)),
    }
    readings = {
        "(": {"args": "Args", "params": "Params", "expr": "Whole", "forh": "ForHead", "annargs": "AnnArgs", "catch": "CatchHead", "resources": "Resources", "cast": "Cast", "castp": "CastP", "ids": "Ids"},
        "[": {"index": "Whole", "dim": "Dim"},
        "{": {"block": "Stmts", "class": "Class", "enum": "Enum", "init": "Init", "switch": "Switch"},
    }
    lists = {"Members": "MembersX", "Stmts": "StmtsX", "Class": "ClassX"}
    g = Grammar(JAVA, kinds, classes, readings, lists, _items(of("else catch finally while , . = ? : + - * / && || == != < >"), ";"))
    return Language(g, Kinds(kinds, _classify_c), JAVA_TOKEN, "Program", lambda s: s)


def _classify_c(t: str) -> str:
    c = t[:1]
    if not c:
        return ""
    if c in "\"'" or c in "$@" and '"' in t:
        return STRING if len(t) > 1 else BAD
    if c.isdigit() or c == "." and len(t) > 1:
        return NUMBER
    if c == "#":
        return ""
    if c.isalpha() or c in "_$@":
        return IDENT
    return BAD


# --------------------------------------------------------------------------------------------------------------- C#
# fixed values: the words and marks of the language
CS_RESERVED = "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while"
CS_CONTEXT = "add alias and ascending async await by descending dynamic equals file from get global group init into join let nameof not notnull on or orderby partial record remove required scoped select set unmanaged value var when where with yield"
CS_MARKS = "{ } ( ) [ ] ; , . :: : ? ?? ??= ?. => -> < > <= >= == != && || ! ~ + - * / % & | ^ << ++ -- = += -= *= /= %= &= |= ^= <<= >>= .."

CS = """
Program <- ('extern' 'alias' Id ';')* Using* GlobalAttr* Space !.
Using <- 'global'? 'using' ('static' / 'unsafe')* (Id '=')? Type ';'
GlobalAttr <- @attr
Space <- ('namespace' QName ';' Using* TopList / TopList)
Top <- (Using)* TopList !.
TopX <- TopList '\x01' !.
TopList <- (';' / Using / Namespace / TypeDecl / Stmt)*
Namespace <- @attr* 'namespace' QName @space ';'?
Id <- IDENT / CONTEXT
QName <- Id ('.' Id)*
Attr <- (Id ':' / 'return' ':' / 'event' ':')? AttrItem (',' AttrItem)* ','? !.
AttrItem <- (Id '::')? QName TypeArgs? @args?
Mods <- @attr* MODIFIER*
TypeDecl <- Mods (Record / ClassDecl / EnumDecl / Delegate)
ClassDecl <- ('ref')? ('class' / 'struct' / 'interface') Id TypeParams? @params? Bases? Where* (@class ';'? / ';')
Record <- 'record' ('class' / 'struct')? Id TypeParams? @params? Bases? Where* (@class ';'? / ';')
Bases <- ':' Type @args? (',' Type)*
Where <- 'where' Id ':' Constraint (',' Constraint)*
Constraint <- 'new' @args / 'class' '?'? / 'struct' / 'unmanaged' / 'notnull' / 'default' / Type
EnumDecl <- 'enum' Id (':' Type)? @enum ';'?
Delegate <- 'delegate' Type Id TypeParams? @params Where* ';'
Enum <- (EnumItem (',' EnumItem)* ','?)? !.
EnumItem <- @attr* Id ('=' Expr)?
Class <- MemberList !.
ClassX <- MemberList '\x01' !.
MemberList <- (';' / Member)*
Member <- Mods (Record / ClassDecl / EnumDecl / Delegate / 'event' Type (Declarator (',' Declarator)* ';' / QType @accessors)
    / ('implicit' / 'explicit') 'operator' Type @params Body / '~'? Id @params (':' ('base' / 'this') @args)? Body
    / 'ref'? 'readonly'? Type (('operator' OPER+ / (QType '.')? 'this' / QType) Rest / 'operator' ('true' / 'false') @params Body))
Rest <- TypeParams? @params Where* Body / @tparams @accessors / @tparams '=>' Expr ';' / @accessors ('=' (@init / Expr) ';')? / '=>' Expr ';' / ('=' (@init / Expr))? (',' Declarator)* ';' / @fixed (',' Declarator)* ';'
QType <- Id TypeParams? ('.' Id TypeParams?)*
Body <- @block / '=>' (Throw / 'ref'? Expr) ';' / ';'
Accessors <- Accessor+ !.
Accessor <- Mods ('get' / 'set' / 'init' / 'add' / 'remove') Body
Declarator <- Id ('=' (@init / 'ref'? Expr))?
Params <- (Param (',' Param)*)? !.
Param <- @attr* PARAMMOD* Type Id ('=' Expr)? / '__arglist'
TParams <- Param (',' Param)* !.
Type <- 'ref'? 'readonly'? ('delegate' '*' TypeArgs / @tuple / PRIMITIVE / QualType) ('?' !STARTEXPR_)? (@rank '?'? / '*')*
QualType <- (Id '::')? Id TypeArgs? ('.' Id TypeArgs?)*
STARTEXPR_ <- NUMBER / STRING / '!' / 'new' / 'this' / 'true' / 'false' / 'null'
Rank <- ','* !.
Tuple <- Type Id? (',' Type Id?)+ !.
TypeArgs <- '<' (@attr* ('in' / 'out')? Type (',' Type)* / ','*) '>'
TypeParams <- '<' @attr* ('in' / 'out')? Type (',' @attr* ('in' / 'out')? Type)* '>'
Stmts <- StmtList !.
StmtsX <- StmtList '\x01' !.
StmtList <- Stmt*
Stmt <- @block / ';' / 'if' @expr Stmt ('else' Stmt)? / 'while' @expr Stmt / 'do' Stmt 'while' @expr ';' / 'for' @forh Stmt / 'await'? 'foreach' @each Stmt
    / 'switch' (@expr / @args) @switch / 'try' @block (Catch+ Finally? / Finally) / 'lock' @expr Stmt / 'await'? 'using' @resource Stmt / 'await'? 'using' LocalVar ';'
    / 'fixed' @resource Stmt / ('checked' / 'unchecked' / 'unsafe') @block / 'return' 'ref'? Expr? ';' / Throw ';' / 'break' ';' / 'continue' ';' / 'goto' ('case' Expr / 'default' / Id) ';'
    / 'yield' ('return' Expr / 'break') ';' / LocalFunc / Id ':' Stmt / 'const'? LocalVar ';' / !NOEXPR Expr ';'
LocalFunc <- @attr* ('static' / 'async' / 'unsafe' / 'extern')* 'ref'? Type Id TypeParams? @params Where* (@block / '=>' Expr ';')
LocalVar <- 'scoped'? Type Declarator (',' Declarator)*
Catch <- 'catch' @catch? ('when' @expr)? @block
CatchHead <- Type Id? !.
Finally <- 'finally' @block
Each <- (Type Id / 'var' @designation / @targets) 'in' Expr !.
Designation <- (Id / @designation) (',' (Id / @designation))* !.
Targets <- Expr (',' Expr)* !.
Resource <- (LocalVar / Expr) !.
ForHead <- (LocalVar / Expr (',' Expr)*)? ';' Expr? ';' (Expr (',' Expr)*)? !.
Switch <- (SwitchLabel+ (!('case' / 'default' ':') Stmt)*)* !.
SwitchLabel <- 'case' Pattern ('when' Expr)? ':' / 'default' ':'
Arms <- (Pattern ('when' Expr)? '=>' (Throw / Expr) (',' / !.))* !.
Pattern <- AndPat ('or' AndPat)*
AndPat <- NotPat ('and' NotPat)*
NotPat <- 'not' NotPat / ('<' / '>' / '<=' / '>=') Shift / 'var' (Id / @designation) / Type? @positional? @property Id? / Type @positional Id? / @positional Id? / @listpat Id? / Type Id !. / Type !CONTEXTOP Id &PATEND / Shift / Type
PATEND <- ':' / '=>' / ',' / ')' / 'when' / 'and' / 'or' / '&&' / '||' / '?' / ';' / '==' / '!='
CONTEXTOP <- 'and' / 'or' / 'when'
Positional <- (SubPat (',' SubPat)*)? !.
SubPat <- (QName ':')? Pattern
Property <- (QName ':' Pattern (',' QName ':' Pattern)* ','?)? !.
ListPat <- (('..' Pattern? / Pattern) (',' ('..' Pattern? / Pattern))* ','?)? !.
Throw <- 'throw' Expr?
Args <- (Arg (',' Arg)*)? !.
Arg <- (Id ':')? ('ref' / 'out' / 'in')? (('var' / Type) Id &(',' / !.) / 'var' @designation / Expr)
Whole <- Expr !.
Cast <- Type !.
Init <- (InitItem (',' InitItem)* ','?)? !.
InitItem <- (Id / @index) '=' (@init / 'ref'? Expr) / @init / '..' Cond / Expr
Lambda <- @attr* ('static' / 'async')* (Id / @params / @lparams / Type @params) '=>' (@block / Throw / 'ref'? Expr) / ('static' / 'async')* 'delegate' @params? @block
LParams <- (PARAMMOD* Id ('=' Expr)? (',' PARAMMOD* Id ('=' Expr)?)*)? !.
Expr <- Lambda / Query / Throw / Cond (Assign_ ('ref'? Expr))?
Assign_ <- ASSIGN
Query <- 'from' (Type Id / Id) 'in' Cond QClause* ('select' Expr / 'group' Expr 'by' Expr) ('into' Id QClause* ('select' Expr / 'group' Expr 'by' Expr))*
QClause <- 'from' (Type Id / Id) 'in' Cond / 'let' Id '=' Expr / 'where' Expr / 'join' (Type Id / Id) 'in' Cond 'on' Cond 'equals' Cond ('into' Id)? / 'orderby' Cond ('ascending' / 'descending')? (',' Cond ('ascending' / 'descending')?)*
Cond <- Coal ('?' ('ref'? Expr) ':' ('ref'? Expr))?
Coal <- Bin ('??' (Throw / Bin))*
Bin <- Range ('is' Pattern / 'as' Type / Op Range)*
Shift <- Range (SHIFTOP Range)*
Range <- Unary? '..' Unary? / Unary
Op <- '>' '>'? '>'? / BINARY
Unary <- UNARY Unary / 'await' Unary / '^' Unary / @cast &CASTABLE Unary / @castp Unary / Postfix
CastP <- PRIMITIVE '?'? @rank? !.
Postfix <- Primary Tail* 
Tail <- ('.' / '->') Id TypeArgs &(@args / '.' / ')' / ',' / ';' / !.) / ('.' / '->') Id / '?.' Id TypeArgs? / '?' @index / @args / @index / '++' / '--' / '!' / 'switch' @arms / 'with' @init / '::' Id
Primary <- 'new' (@init / @rank @init / @args @init? / Type (@args @init? / @init / @index @rank* @init?)) / 'typeof' @cast / ('default' / 'sizeof' / 'checked' / 'unchecked' / 'nameof' / 'stackalloc' Type) @args? @index? @init?
    / LITERAL / 'this' / 'base' / PRIMITIVE &'.' / Id TypeArgs &(@args / '.' / '::') / Id / @expr / @tuplex / @index / @list
TupleX <- (Id ':')? TupleItem (',' (Id ':')? TupleItem)+ !.
TupleItem <- Type Id &(',' / !.) / Expr
List <- (('..' Expr / Expr) (',' ('..' Expr / Expr))* ','?)? !.
"""
_CS_HOLE = r"\{(?:[^{}\"]|\"(?:[^\"\\\n]|\\.)*\"|\{[^{}]*\})*\}"
CS_TOKEN = re.compile(
    _C_SKIP
    + r"((?:^[ \t]*)?#[ \t]*(?:region|endregion|if|elif|else|endif|define|undef|pragma|nullable|line|warning|error)\b[^\n\r]*"
    + r'|\$*"""(?:"*)(?:[^"]|"{1,2}(?!"))*"""+'
    + rf'|(?:\$@|@\$)"(?:[^"{{}}]|""|\{{\{{|\}}\}}|{_CS_HOLE})*"|@"(?:[^"]|"")*"|\$"(?:[^"\\{{}}\n\r]|\\[^\n\r]|\{{\{{|\}}\}}|{_CS_HOLE})*"|"(?:[^"\\\n\r]|\\[^\n\r])*"(?:u8)?'
    + r"|'(?:[^'\\\n\r]|\\(?:x[0-9A-Fa-f]{1,4}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[^\n\r]))'"
    + r"|@?[^\W\d]\w*|(?:0[xX][\dA-Fa-f_]+|0[bB][01_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)(?:[uU][lL]?|[lL][uU]?|[fFdDmM])?(?!\w)"
    + r"|\?\?=|\?\?|\?\.(?!\d)|=>|->|::|\.\.|<<=|>>=|\+\+|--|&&|\|\||<<|<=|>=|==|!=|[-+*/%&|^]=|[{}()\[\];,.@<>=!~?:+\-*/%&|^]|\Z|[\s\S])",
    re.M,
)


def _cs() -> Language:
    kinds = _kinds(f"{CS_RESERVED} {CS_CONTEXT} __arglist", CS_MARKS)
    of = lambda words: "".join(kinds[w] for w in words.split())
    classes = {
        "IDENT": IDENT, "NUMBER": NUMBER, "STRING": STRING, "CONTEXT": of(CS_CONTEXT), "LITERAL": NUMBER + STRING + of("true false null"),
        "MODIFIER": of("public private protected internal static abstract sealed readonly override virtual extern unsafe volatile const new async partial required file fixed"),
        "PRIMITIVE": of("bool byte char decimal double float int long object sbyte short string uint ulong ushort void"), "PARAMMOD": of("ref out in params this scoped readonly"),
        "ASSIGN": of("= += -= *= /= %= &= |= ^= <<= >>= ??="), "BINARY": of("+ - * / % & | ^ && || == != < <= >= <<"), "SHIFTOP": of("+ - * / % << | &"),
        "UNARY": of("+ - ! ~ ++ -- & *"), "OPER": of("+ - ! ~ ++ -- * / % & | ^ << == != < > <= >="), "NOEXPR": of("class else case catch finally namespace"),
        "CASTABLE": IDENT + NUMBER + STRING + of(f"{CS_CONTEXT} this base new true false null ! ~ typeof default sizeof") + of("bool byte char decimal double float int long object sbyte short string uint ulong ushort") + "".join(chr(FIRST + n) for n in range(SPAN)),
    }
    readings = {
        "(": {"args": "Args", "params": "Params", "expr": "Whole", "forh": "ForHead", "each": "Each", "catch": "CatchHead", "resource": "Resource", "cast": "Cast", "castp": "CastP", "lparams": "LParams", "tuplex": "Tup"},
        "[": {"index": "Args", "rank": "Rank", "attr": "Attr", "tparams": "TParams", "list": "List", "listpat": "ListPat", "fixed": "Whole"},
        "{": {"block": "Stmts", "class": "Class", "enum": "Enum", "init": "Init", "switch": "Switch", "accessors": "Accessors", "space": "Top", "arms": "Arms", "property": "Property"},
    }
    # eleven readings fill the room of a kind of bracket: tuples of types, of values, of targets and of patterns share one
    text = CS.replace("@tuple ", "@tuplex ").replace("@designation", "@tuplex").replace("@targets", "@tuplex").replace("@positional", "@tuplex") + "\nTup <- TupleX / Tuple / Designation / Positional\n"
    lists = {"Top": "TopX", "Stmts": "StmtsX", "Class": "ClassX"}
    g = Grammar(text, kinds, classes, readings, lists, _items(of("else catch finally while , . = ? : + - * / && || == != < > =>"), ";"))
    return Language(g, Kinds(kinds, _classify_c), CS_TOKEN, "Program", lambda s: s)
# ------------------------------------------------------------------------------------------------------------- Python
# fixed values: the words and marks of the language
PY_RESERVED = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
PY_CONTEXT = "match case type"
PY_MARKS = "{ } ( ) [ ] ; , . ... : := -> @ = == != < > <= >= + - * / // % ** & | ^ ~ << >> += -= *= /= //= %= **= &= |= ^= <<= >>= @="

PY = """
Line <- Header (Simple / !.) / 'case' Patterns ('if' Named)? ':' (Simple / !.) / '@' Named !. / Simple
Header <- ('if' / 'elif' / 'while') Named ':' / ('else' / 'try' / 'finally') ':' / 'async'? 'for' Targets 'in' Stars ':' / 'except' ('*'? Expr (',' Expr)* ('as' Id)?)? ':' / 'async'? 'with' (@with / WithItem (',' WithItem)*) ':'
    / 'async'? 'def' Id @tparams? @params ('->' Expr)? ':' / 'class' Id @tparams? @args? ':' / 'match' Stars ':' !.
Simple <- Small (';' Small)* ';'? !.
Small <- 'pass' / 'break' / 'continue' / 'return' Stars? / 'raise' (Expr ('from' Expr)?)? / ('global' / 'nonlocal') Id (',' Id)* / 'del' Targets / 'assert' Expr (',' Expr)? / Import
    / 'type' Id @tparams? '=' Expr / Stars (':' Expr ('=' (Yield / Stars))? / AUGMENT (Yield / Stars) / ('=' (Yield / Stars))*) / Yield
Import <- 'import' Dotted ('as' Id)? (',' Dotted ('as' Id)?)* / 'from' (('.' / '...')+ Dotted? / Dotted) 'import' ('*' / @names / ImportName (',' ImportName)*)
Dotted <- Id ('.' Id)*
ImportName <- Id ('as' Id)?
Names <- ImportName (',' ImportName)* ','? !.
Id <- IDENT / CONTEXT
Yield <- 'yield' ('from' Expr / Stars)?
Stars <- Star (',' Star)* ','?
Star <- '*' Expr / Named
Named <- Id ':=' Expr / Expr
Expr <- 'lambda' (LParam (',' LParam)* ','?)? ':' Expr / Chain ('if' Chain 'else' Expr)?
Chain <- Operand (Op Operand)*
Op <- 'not' 'in' / 'is' 'not'? / BINARY
Operand <- UNARY Operand / 'await'? Postfix
Postfix <- Atom ('.' Id / @args / @subs)*
Atom <- Id / STRING+ / LITERAL / @group / @list / @dict
Targets <- Target (',' Target)* ','?
Target <- '*'? Postfix
LParam <- ('*' / '**') Id / ('*' / '/') / Id ('=' Expr)?
Params <- (Param (',' Param)* ','?)? !.
Param <- '*' Id (':' ('*' Expr / Expr))? / '**' Id (':' Expr)? / ('*' / '/') / Id (':' Expr)? ('=' Expr)?
TParams <- ('*' / '**')? Id (':' Expr)? ('=' Expr)? (',' ('*' / '**')? Id (':' Expr)? ('=' Expr)?)* ','? !.
Args <- (Arg (',' Arg)* ','?)? !.
Arg <- ('*' / '**') Expr / Id '=' Expr / Named CompFor*
CompFor <- 'async'? 'for' Targets 'in' Chain ('if' (Id ':=' Chain / Chain))*
Group <- !. / Yield !. / Star (CompFor+ / (',' Star)* ','?) !.
List <- !. / Star (CompFor+ / (',' Star)* ','?) !.
Dict <- !. / DictItem (CompFor+ / (',' DictItem)* ','?) !.
DictItem <- '**' Chain / Expr ':' Expr / Star
Subs <- Slice (',' Slice)* ','? !.
Slice <- Expr? ':' Expr? (':' Expr?)? / Star
WithAll <- WithItem (',' WithItem)* ','? !.
WithItem <- Expr ('as' Target)?
Patterns <- Pattern (',' Pattern)* ','?
Pattern <- '*'? Closed ('|' Closed)* ('as' Id)?
Closed <- '-'? (LITERAL / STRING+) (('+' / '-') LITERAL)? / Dotted @pargs? / @pargs / @plist / @pdict
PArgs <- ((Id '=')? Pattern (',' (Id '=')? Pattern)* ','?)? !.
PList <- (Pattern (',' Pattern)* ','?)? !.
PDict <- (PItem (',' PItem)* ','?)? !.
PItem <- '**' Id / Closed ':' Pattern
"""
_PY_STR = r"(?:[rR][bB]?|[bB][rR]?|[uU]|[fF][rR]?|[rR][fF]|[tT][rR]?)?"
PY_TOKEN = re.compile(
    r"(?:[ \t\f]+|\\(?:\r\n|\n|\r)|﻿)*"
    r"((?:#[^\n\r]*)?(?:(?:\r\n|\n|\r)[ \t\f]*(?:#[^\n\r]*)?)+|#[^\n\r]*\Z"
    rf"|{_PY_STR}(?:'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\")"
    r"|[^\W\d]\w*|(?:0[xX][\dA-Fa-f_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?[jJ]?|\.\d[\d_]*(?:[eE][+-]?\d+)?[jJ]?)(?!\w)"
    r"|\.\.\.|:=|->|\*\*=|//=|<<=|>>=|\*\*|//|<<|>>|<=|>=|==|!=|[-+*/%&|^@]=|[{}()\[\];,.@<>=~:+\-*/%&|^]|\Z|[\s\S])"
)
INDENT = 0xF0000 + 0x8000


class PythonLanguage(Language):
    """Logical lines are parsed by the grammar; how they nest by indentation is checked on their heads."""

    #: What a clause may follow at its own level.
    FOLLOWS = {"elif": "if elif", "else": "if elif for while try except", "except": "try except", "finally": "try except else"}

    def __init__(self, *a) -> None:
        super().__init__(*a)
        self.heads = {v: k for k, v in self.kinds.known.items()}
        self.lines: dict[str, tuple[str, bool] | None] = {}

    def line(self, s: str) -> tuple[str, bool] | None:
        """The first word of a logical line and whether it needs a block; None if it doesn't parse."""
        r = self.lines.get(s, 0)
        if r == 0:
            g = self.grammar
            r = None
            if g.parse("Line", s) < 0:
                word = self.heads.get(s[0], "")
                if word == "async":
                    word = self.heads.get(s[1], "")
                needs = False
                if s[-1] == ":":
                    g.table.clear()
                    needs = g.rules["Header"](s, 0) == len(s) or word == "case"
                r = (word if needs or word in ("elif", "else", "except", "finally", "@") or self._header(s) else "", needs)
            if len(s) <= KEPT:
                if len(self.lines) >= TABLE:
                    self.lines.clear()
                self.lines[s] = r
        return r

    def _header(self, s: str) -> bool:
        self.grammar.table.clear()
        return self.grammar.rules["Header"](s, 0) > 0

    def valid(self, text: str) -> bool:
        return self.fault(self.grammar.reduce(self.logical(text))) is None

    def logical(self, text: str) -> str:
        """Kinds with every logical line behind a line break and its indentation."""
        s = self.flat(text)
        return s if s.startswith("\n") else "\n" + chr(INDENT + len(text) - len(text.lstrip(" \t"))) + s

    def fault(self, s: str) -> int | None:
        """The number of the first logical line that is wrong, or None."""
        levels, last, wants, decorated, at = [0], [""], False, False, -1
        for at, raw in enumerate(s.split("\n")[1:]):
            if len(raw) < 2:
                continue
            indent, body = ord(raw[0]) - INDENT, raw[1:]
            r = self.line(body)
            if r is None:
                return at
            word, needs = r
            if wants:
                if indent <= levels[-1]:
                    return at
                levels.append(indent)
                last.append("")
            else:
                if indent > levels[-1]:
                    return at
                while indent < levels[-1]:
                    levels.pop()
                    if last.pop() == "try":
                        return at
                if indent != levels[-1]:
                    return at
            if last[-1] == "try" and word not in ("except", "finally"):
                return at
            if word in self.FOLLOWS and last[-1] not in self.FOLLOWS[word].split():
                return at
            if word == "case" and len(last) > 1 and last[-2] != "match":
                return at
            if decorated and word not in ("def", "class", "@"):
                return at
            decorated = word == "@"
            last[-1], wants = word, needs
        return at + 1 if wants or decorated or "try" in last else None


def _py() -> Language:
    kinds = _kinds(f"{PY_RESERVED} {PY_CONTEXT}", PY_MARKS)
    of = lambda words: "".join(kinds[w] for w in words.split())
    classes = {
        "IDENT": IDENT, "CONTEXT": of(PY_CONTEXT), "STRING": STRING, "LITERAL": NUMBER + of("None True False ..."), "AUGMENT": of("+= -= *= /= //= %= **= &= |= ^= <<= >>= @="),
        "BINARY": of("+ - * / // % ** & | ^ << >> == != < > <= >= and or in @"), "UNARY": of("+ - ~ not"),
    }
    readings = {
        "(": {"args": "Args", "group": "Group", "params": "Params", "names": "Names", "with": "WithAll", "pargs": "PArgs"},
        "[": {"list": "List", "subs": "Subs", "tparams": "TParams", "plist": "PList"},
        "{": {"dict": "Dict", "pdict": "PDict"},
    }
    g = Grammar(PY, kinds, classes, readings, {}, None, r"\n.")

    def classify(t: str) -> str:
        c = t[:1]
        if not c:
            return ""
        if c in "\r\n#":
            if "\n" not in t and "\r" not in t:
                return ""
            tail = re.split(r"[\r\n]", t)[-1]
            if tail.lstrip(" \t\f")[:1] == "#":
                return ""
            return "\n" + chr(INDENT + min(len(tail.replace("\f", "").expandtabs(8)), 2000))
        if c in "'\"" or t[-1] in "'\"" and len(t) > 2:
            return STRING if len(t) > 1 else BAD
        if c.isdigit() or c == "." and len(t) > 1:
            return NUMBER
        return IDENT if c.isalpha() or c == "_" else BAD

    known = {k: v for k, v in kinds.items() if k != "\n"}
    return PythonLanguage(g, Kinds(known, classify), PY_TOKEN, "Line", lambda s: s)


# --------------------------------------------------------------------------------------------------------------- JSON
JSON = """
Program <- Value !.
Value <- STRING / NUMBER / 'true' / 'false' / 'null' / @object / @array
Object <- (STRING ':' Value (',' STRING ':' Value)*)? !.
Array <- (Value (',' Value)*)? !.
Nothing <- 'true' 'false'
"""
JSON_TOKEN = re.compile(
    r"[ \t\r\n]*(\A﻿|\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9A-Fa-f]{4}))*\"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|true\b|false\b|null\b|[{}\[\],:]|\Z|[\s\S])", re.ASCII
)


def _json() -> Language:
    kinds = _kinds("true false null", "{ } [ ] ( ) , :")
    g = Grammar(JSON, kinds, {"STRING": STRING, "NUMBER": NUMBER}, {"(": {"none": "Nothing"}, "[": {"array": "Array"}, "{": {"object": "Object"}}, {})

    def classify(t: str) -> str:
        if t in ("", "﻿"):
            return ""
        if len(t) > 1 and t[0] == '"':
            return STRING
        return NUMBER if t[0] in "-0123456789" and t != "-" else BAD

    return Language(g, Kinds(kinds, classify), JSON_TOKEN, "Program", lambda s: s)


MAKERS = {"ts": lambda: _es(True), "js": lambda: _es(False), "mjs": lambda: _es(False), "java": _java, "cs": _cs, "py": _py, "json": _json}
_MADE: dict[str, Language] = {}


def language(ext: str) -> Language | None:
    """The language of an extension, made once in each process; None for an unknown one."""
    if ext == "mjs":
        ext = "js"
    if ext not in _MADE and ext in MAKERS:
        _MADE[ext] = MAKERS[ext]()
    return _MADE.get(ext)
