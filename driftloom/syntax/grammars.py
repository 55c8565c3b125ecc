"""The grammars of the languages whose files are checked: ECMAScript modules, TypeScript and JSON."""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Callable

from driftloom.syntax.peg import Parsed, compile_grammar

# Parts in double square brackets belong to TypeScript only, those in double angle quotes to ECMAScript only: what the module
# parser refuses early (targets of assignments, break, continue, yield and super out of place, repeated names), the TypeScript
# parser takes and leaves to the checker.
_SCRIPT = r"""
ModuleItem <- ImportItem / ExportItem / Statement
ImportItem <- 'import' !('(' / '.') ( STRING Attributes_? SEMI_
    / [['type' ImportClause 'from' STRING Attributes_? SEMI_ /]] ImportClause 'from' STRING Attributes_? SEMI_
    [[/ 'type'? IDENT '=' ('require' '(' STRING ')' / EntityName) SEMI_]] )
ImportClause <- IDENT (',' (NamespaceImport_ / NamedImports))? / NamespaceImport_ / NamedImports
NamespaceImport_ <- '*' 'as' IDENT
NamedImports <- '{' (ImportSpec (',' ImportSpec)* ','?)? '}'
ImportSpec <- [['type' (NAME / STRING) 'as' IDENT &(',' / '}') / 'type' IDENT &(',' / '}') /]] (NAME / STRING) 'as' IDENT / IDENT
Attributes_ <- 'with' ObjectLiteral / NONL 'assert' ObjectLiteral
ExportItem <- 'export' ( '*' ('as' (NAME / STRING))? 'from' STRING Attributes_? SEMI_
    [[/ 'type' '*' ('as' (NAME / STRING))? 'from' STRING Attributes_? SEMI_ / 'type' ExportNames ('from' STRING Attributes_?)? SEMI_]]
    / ExportNames ('from' STRING Attributes_?)? SEMI_
    / 'default' ExportDefault
    [[/ '=' Expression SEMI_ / 'as' 'namespace' IDENT SEMI_ / 'import' 'type'? IDENT '=' ('require' '(' STRING ')' / EntityName) SEMI_]]
    / VariableStatement / FunctionDeclaration / Decorator* ClassDeclaration [[/ TypeDeclaration]] )
ExportNames <- '{' (ExportSpec (',' ExportSpec)* ','?)? '}'
ExportSpec <- [['type' (NAME / STRING) ('as' (NAME / STRING))? &(',' / '}') /]] (NAME / STRING) ('as' (NAME / STRING))?
ExportDefault <- DefaultFunction / Decorator* [['abstract'?]] ClassExpression [[/ InterfaceDeclaration]] / !('function' / 'class' / 'async' NONL 'function') Assign SEMI_
DefaultFunction <- ('async' NONL)? 'function' ('*' IDENT? Signature (GeneratorBody [[/ SEMI_]]) / IDENT? Signature (FunctionBody [[/ SEMI_]]))

Statement <- Block / ';' / VariableStatement / FunctionDeclaration / Decorator* ClassDeclaration / If / For / While / Do
    / 'return' IN_FUNCTION (NONL !(';' / '}' / EOF) Expression)? SEMI_ / [[('break' / 'continue') (NONL IDENT)? SEMI_]]
    «'break' (NONL LABEL / !(NONL IDENT) IN_BREAK) SEMI_ / 'continue' IN_LOOP (NONL LABEL / !(NONL IDENT)) SEMI_»
    / 'throw' NONL Expression SEMI_ / Switch / Try / 'debugger' SEMI_ [[/ TypeDeclaration]] / Labelled
    / !('{' / 'function' / 'class' / 'async' NONL 'function') Expression SEMI_
Labelled <- IDENT ':' Statement
LoopBody <- Statement
SwitchBody <- '{' ('case' Expression ':' Statement* / 'default' ':' Statement*)* '}'
SEMI_ <- ';' / &'}' / NL
Block <- '{' Statement* '}'
VariableStatement <- VariableList SEMI_
VariableList <- ('let' / 'var' / 'using') Variable (',' Variable)* / 'const' [[!'enum']] Constant (',' Constant)*
Variable <- IDENT [['!'?]] TypeAnnotation_? ('=' Assign)? / Pattern TypeAnnotation_? '=' Assign
Constant <- Target TypeAnnotation_? '=' Assign
Target <- IDENT / Pattern
Pattern <- '{' (PatternProperty (',' PatternProperty)* ','?)? '}' / '[' (','* PatternElement (','+ PatternElement)*)? ','* ']'
PatternProperty <- '...' Target / PropertyName ':' Target ('=' Assign)? / IDENT ('=' Assign)?
PatternElement <- '...'? Target ('=' Assign)?
FunctionDeclaration <- ('async' NONL)? 'function' ('*' IDENT Signature (GeneratorBody [[/ SEMI_]]) / IDENT Signature (FunctionBody [[/ SEMI_]]))
Signature <- [[TypeParameters?]] '(' [[Parameters]] «DistinctParameters» ')' [[ReturnAnnotation_?]]
Parameters <- (Parameter (',' Parameter)* ','?)?
Parameter <- [[Decorator* ParameterModifier_*]] '...' Target TypeAnnotation_? / [[Decorator* ParameterModifier_* 'this' TypeAnnotation_ / Decorator* ParameterModifier_*]] Target [['?'?]] TypeAnnotation_? ('=' Assign)?
«DistinctParameters <- Parameters»
FunctionBody <- '{' Statement* '}'
ArrowBody <- '{' Statement* '}'
GeneratorBody <- '{' Statement* '}'
ConstructorBody <- '{' Statement* '}'
If <- 'if' '(' Expression ')' Statement ('else' Statement)?
For <- 'for' 'await'? '(' ( (('let' / 'const' / 'var') Target / [[LeftHand]] «AssignPattern / SimpleTarget») ('of' Assign / 'in' Expression) ')'
    / (VariableList / Expression)? ';' Expression? ';' Expression? ')' ) LoopBody
While <- 'while' '(' Expression ')' LoopBody
Do <- 'do' LoopBody 'while' '(' Expression ')' ';'?
Switch <- 'switch' '(' Expression ')' SwitchBody
Try <- 'try' Block ('catch' ('(' Target TypeAnnotation_? ')')? Block ('finally' Block)? / 'finally' Block)
Decorator <- '@' ('(' Expression ')' / IDENT ('.' NAME)* [[TypeArguments?]] Arguments?)

ClassDeclaration <- [['abstract'?]] 'class' IDENT ClassTail
ClassExpression <- 'class' IDENT? ClassTail
ClassTail <- [[TypeParameters?]] ('extends' LeftHand [[TypeArguments?]])? [[('implements' TypeReference (',' TypeReference)*)?]] '{' ClassElement* '}'
ClassElement <- ';' / 'static' FunctionBody / Decorator* Modifier_* ( [[IndexSignature SEMI_ /]] ('get' / 'set') PropertyName Signature (FunctionBody [[/ SEMI_]])
    / '*' PropertyName [[('?' / '!')?]] Signature (GeneratorBody [[/ SEMI_]]) / 'constructor' Signature (ConstructorBody [[/ SEMI_]]) / PropertyName [[('?' / '!')?]] Signature (FunctionBody [[/ SEMI_]])
    / PropertyName [[('?' / '!')?]] TypeAnnotation_? ('=' Assign)? SEMI_ )
Modifier_ <- ('static' / 'async' NONL / 'accessor' [[/ 'public' / 'private' / 'protected' / 'readonly' / 'abstract' / 'override' / 'declare']]) !('(' / '=' / ';' / '}' / '?' / '!' / ':' / ',' / '<')

Expression <- Assign (',' Assign)*
Substitution <- Expression
Assign <- Arrow / 'yield' «IN_GENERATOR» (NONL '*'? Assign)? / [[LeftHand AssignmentOperator_ Assign]] «AssignPattern '=' Assign / &(LeftHand AssignmentOperator_) SimpleTarget AssignmentOperator_ Assign» / Conditional
«SimpleTarget <- '(' SimpleTarget ')' !Suffix_ / !('eval' / 'arguments') IDENT !Suffix_ / Primary ((Arguments / TEMPLATE)* ('.' (NAME / PRIVATE) / '[' Expression ']'))+
AssignPattern <- '{' (AssignProperty (',' AssignProperty)* ','?)? '}' / '[' (','* ArrayTarget (','+ ArrayTarget)*)? ','* ']'
AssignProperty <- '...' SimpleTarget / PropertyName ':' AssignElement / IDENT ('=' Assign)?
AssignElement <- (AssignPattern &('=' / ',' / '}' / ']' / 'of' / 'in') / SimpleTarget) ('=' Assign)?
ArrayTarget <- '...' AssignElement / AssignElement»
AssignmentOperator_ <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '<<=' / '>>=' / '>>>=' / '&=' / '|=' / '^=' / '&&=' / '||=' / '??='
Arrow <- ('async' NONL &(IDENT / '(' / '<'))? (IDENT / Signature) NONL '=>' (ArrowBody / !'{' Assign)
[[PlainArrow <- ('async' NONL &(IDENT / '('))? (IDENT / '(' Parameters ')') NONL '=>' (ArrowBody / !'{' PlainAssign)
PlainAssign <- PlainArrow / LeftHand AssignmentOperator_ Assign / Conditional]]
Conditional <- Binary ('?' (Assign ':' Assign [[/ PlainAssign ':' Assign]]))?
Binary <- (Unary / PRIVATE &'in') (BinaryOperator_ Unary [[/ NONL ('as' / 'satisfies') ('const' / Type)]])*
BinaryOperator_ <- '+' / '-' / '*' / '/' / '%' / '**' / '==' / '!=' / '===' / '!==' / '<' / '>' / '<=' / '>=' / '&&' / '||' / '??' / '&' / '|' / '^' / '<<' / '>>' / '>>>' / 'in' / 'instanceof'
Unary <- ('delete' / 'void' / 'typeof' / '+' / '-' / '~' / '!' / 'await' [[/ '++' / '--']]) Unary «/ ('++' / '--') SimpleTarget !Suffix_» [[/ '<' ('const' / Type) GT Unary]] / Postfix
Postfix <- [[LeftHand (NONL ('++' / '--'))?]] «LeftHand !(NONL ('++' / '--')) / SimpleTarget NONL ('++' / '--')»
LeftHand <- Primary Suffix_*
Suffix_ <- '.' (NAME / PRIVATE) / '?.' ([[TypeArguments?]] Arguments / '[' Expression ']' / NAME / PRIVATE) / '[' Expression ']' / Arguments / TEMPLATE [[/ NONL '!' / TypeArguments &('(' / TEMPLATE / ')' / ']' / ',' / ';' / ':' / '}' / EOF)]]
Arguments <- '(' (Argument_ (',' Argument_)* ','?)? ')'
Argument_ <- '...'? Assign
Primary <- 'this' / 'null' / 'true' / 'false' / NUMBER / STRING / TEMPLATE / REGEX / FunctionExpression / Decorator* ClassExpression / New
    / ArrayLiteral / ObjectLiteral / '(' Expression ')' / 'super' &('.' / '[' / '(' «IN_CONSTRUCTOR») / 'import' ('(' Assign (',' Assign)? ','? ')' / '.' NAME &('(' / !'(')) / IDENT
FunctionExpression <- ('async' NONL)? 'function' ('*' IDENT? Signature GeneratorBody / IDENT? Signature FunctionBody)
New <- 'new' ('.' NAME / NewTarget [[TypeArguments?]] Arguments?)
NewTarget <- Primary ('.' (NAME / PRIVATE) / '[' Expression ']' / TEMPLATE)*
ArrayLiteral <- '[' ','* (Argument_ (','+ Argument_)*)? ','* ']'
ObjectLiteral <- '{' (Property (',' Property)* ','?)? '}'
Property <- '...' Assign / ('get' / 'set') PropertyName Signature FunctionBody / ('async' NONL !('(' / ',' / ':' / '}' / '=' / '<'))? ('*' PropertyName Signature GeneratorBody / PropertyName Signature FunctionBody)
    / PropertyName ':' Assign / IDENT [[('=' Assign)?]]
PropertyName <- NAME / STRING / NUMBER / '[' Assign ']' / PRIVATE
TypeAnnotation_ <- [[':' Type]]
"""

_TYPES = r"""
ReturnAnnotation_ <- ':' ReturnType
ReturnType <- 'asserts' NONL (IDENT / 'this') ('is' Type)? / (IDENT / 'this') NONL 'is' Type / Type
ParameterModifier_ <- ('public' / 'private' / 'protected' / 'readonly' / 'override') &(NAME / '{' / '[')
AmbientItem <- 'export'? ('let' / 'var' / 'const' !'enum') AmbientVariable (',' AmbientVariable)* SEMI_ / ModuleItem
TypeDeclaration <- 'declare' NONL ( 'global' '{' AmbientItem* '}' / ('let' / 'var' / 'const') AmbientVariable (',' AmbientVariable)* SEMI_ / FunctionDeclaration / ClassDeclaration / TypeDeclaration )
    / 'type' NONL IDENT TypeParameters? '=' Type SEMI_ / InterfaceDeclaration / 'const'? 'enum' IDENT '{' (EnumMember (',' EnumMember)* ','?)? '}'
    / ('namespace' / 'module') NONL (EntityName / STRING) ('{' AmbientItem* '}' / SEMI_)
AmbientVariable <- Target TypeAnnotation_? ('=' Assign)?
InterfaceDeclaration <- 'interface' IDENT TypeParameters? ('extends' TypeReference (',' TypeReference)*)? ObjectType
EnumMember <- PropertyName ('=' Assign)?
EntityName <- IDENT ('.' NAME)*
TypeParameters <- '<' TypeParameter (',' TypeParameter)* ','? GT
TypeParameter <- ('const' / 'in' / 'out' &NAME)* IDENT ('extends' Type)? ('=' Type)?
TypeArguments <- '<' Type (',' Type)* ','? GT
Type <- FunctionType / Union (NONL 'extends' Type '?' Type ':' Type)?
FunctionType <- ('abstract'? 'new')? TypeParameters? '(' Parameters ')' '=>' ReturnType
Union <- '|'? Intersection ('|' Intersection)*
Intersection <- '&'? TypeOperator ('&' TypeOperator)*
TypeOperator <- ('keyof' / 'unique' / 'readonly') TypeOperator / 'infer' IDENT ('extends' Type !'?')? / PostfixType
PostfixType <- PrimaryType (NONL '[' Type? ']')*
PrimaryType <- '(' Type ')' / MappedType / ObjectType / TupleType / STRING / '-'? NUMBER / 'null' / 'true' / 'false' / 'void' / 'this' / TEMPLATE
    / 'typeof' ('import' '(' Type (',' ObjectLiteral)? ')' ('.' NAME)* / ('this' / IDENT) ('.' (NAME / PRIVATE))*) (NONL TypeArguments)?
    / 'import' '(' Type (',' ObjectLiteral)? ')' ('.' NAME)* TypeArguments? / TypeReference
TypeReference <- IDENT ('.' NAME)* (NONL TypeArguments)?
TupleType <- '[' (TupleElement (',' TupleElement)* ','?)? ']'
TupleElement <- '...'? (NAME '?'? ':' Type / Type '?'?)
MappedType <- '{' (('+' / '-')? 'readonly')? '[' IDENT 'in' Type ('as' Type)? ']' (('+' / '-')? '?')? TypeAnnotation_? (';' / ',')? '}'
ObjectType <- '{' (TypeMember (';' / ',' / NL / &'}'))* '}'
TypeMember <- IndexSignature / 'new'? Signature / ('get' / 'set') PropertyName Signature / MemberModifier_* PropertyName '?'? (Signature / TypeAnnotation_?)
MemberModifier_ <- 'readonly' !('(' / '?' / ':' / ';' / ',' / '}' / '<')
IndexSignature <- MemberModifier_* '[' IDENT ':' Type ']' TypeAnnotation_?
"""

_JSON = r"""
Document <- Value EOF
Value <- STRING / '-'? NUMBER / 'true' / 'false' / 'null' / '{' (STRING ':' Value (',' STRING ':' Value)*)? '}' / '[' (Value (',' Value)*)? ']'
Substitution <- Value
"""

# JSON's own tokens are stricter than the script languages'
_JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|true\b|false\b|null\b|[{}\[\],:])')
_MARKER = re.compile(r"^(?:<{7}|>{7}|\|{7})(?:[ \t].*)?$|^={7}$", re.M)


@functools.cache
def grammar(language: str) -> Callable:
    if language == "json":
        return compile_grammar(_JSON)
    if language == "ts":
        return compile_grammar(re.sub(r"\[\[|\]\]|«.*?»", " ", _SCRIPT, flags=re.S) + _TYPES)
    plain = re.sub(r"\[\[.*?\]\]|[«»]", " ", _SCRIPT, flags=re.S)
    plain = re.sub(r"TypeAnnotation_ <-\s*$", "", plain.strip()).replace("TypeAnnotation_?", "")
    return compile_grammar(plain)


def _begin(text: str) -> int:
    """Behind a byte order mark and a #! line."""
    at = 1 if text[:1] == "﻿" else 0
    if text.startswith("#!", at):
        end = re.compile(r"[\n\r]|\Z").search(text, at).start()
        return end
    return at


def json_failure(text: str) -> int | None:
    """None for strict JSON, else the furthest position reached."""
    at = 0
    while True:
        m = _JSON_TOKEN.match(text, at)
        if m is None or m.end() == at:
            break
        at = m.end()
    if text[at:].strip(" \t\n\r"):
        return at  # a token that JSON does not have; what stands before it decides nothing
    p = Parsed(grammar("json"), text)
    return None if p.rules["Document"](0) >= 0 else p.furthest


def script_items(text: str, language: str) -> tuple[list[tuple[int, int]], int | None]:
    """(start, end) of the top-level statements in order, and None, or the furthest position when one does not parse.

    A start is that of the first token; statements behind a failure are not returned.
    """
    p = Parsed(grammar(language), text, at := _begin(text))
    item, out = p.rules["ModuleItem"], []
    while True:
        t = p.token(at)
        if t[0] == "e":
            rest = text[at:]
            return out, None if not _open_comment(rest) else len(text)
        end = item(at)
        if end < 0:
            return out, p.furthest
        out.append((t[2], end))
        at = end


def _open_comment(rest: str) -> bool:
    return rest.count("/*") > 0 and re.sub(r"//[^\n\r]*|/\*[\s\S]*?\*/", "", rest).strip("﻿ \t\r\n") != ""


#: Frames a parse may take: about 150,000 brackets in each other in a script, 2,000,000 in JSON, at about 200 bytes a frame.
RECURSION = 2_000_000
UNDECIDED = -1


def failure(text: str, language: str) -> int | None:
    """None where the text parses in its language, else the furthest failure position; UNDECIDED beyond `RECURSION` frames."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, RECURSION))
    try:
        if language == "json":
            return json_failure(text)
        return script_items(text, language)[1]
    except RecursionError:
        return UNDECIDED
    finally:
        sys.setrecursionlimit(before)


def cause_of(text: str, at: int) -> str:
    """conflict (markers of a merge at or around the failure), end (the text stops too early), or syntax."""
    for m in _MARKER.finditer(text):
        if m.start() <= at <= m.end() + 1 or m.start() <= at and at - m.start() < 400:
            return "conflict"
    return "end" if at >= len(text.rstrip()) else "syntax"
