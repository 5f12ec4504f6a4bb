"""Bundled grammars, in the notation of ``glr.Grammar``.

They follow the languages' published references, with operator precedence flattened (a recognizer needs no tree). Upper-case
names are token classes of ``lexers``; a language's contextual keywords are listed where names are allowed.
"""

PYTHON = r"""
start: (stmt | NL)* ;
stmt: simple | compound ;
simple: small%';' ';'? NL ;
small: stars | stars AOP (stars | yields) | stars ('=' (stars | yields))+ | stars ':' test ('=' (stars | yields))? | yields
  | 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' (test ('from' test)?)? | 'global' name%',' | 'nonlocal' name%','
  | 'del' stars | 'assert' test (',' test)? | imports | 'type' name tparams? '=' test ;
yields: 'yield' stars? | 'yield' 'from' test ;
imports: 'import' dotas%',' | 'from' dots? dotted 'import' importlist | 'from' dots 'import' importlist ;
dots: ('.' | '...')+ ;
importlist: '*' | nameas%',' | '(' nameas%',' ','? ')' ;
dotas: dotted ('as' name)? ;
nameas: name ('as' name)? ;
dotted: name%'.' ;
name: NAME | 'match' | 'case' | 'type' | '_' ;
suite: simple | NL INDENT stmt+ DEDENT ;
compound: decorator+ (func | cls) | func | cls | 'async' (func | withst | forst) | forst | withst
  | 'if' named ':' suite ('elif' named ':' suite)* ('else' ':' suite)?
  | 'while' named ':' suite ('else' ':' suite)?
  | 'try' ':' suite (('except' test ('as' name)? ':' suite)+ ('except' ':' suite)? | 'except' ':' suite) ('else' ':' suite)? ('finally' ':' suite)?
  | 'try' ':' suite ('except' test%',' ':' suite)+ ('else' ':' suite)? ('finally' ':' suite)?
  | 'try' ':' suite ('except' '*' test%',' ('as' name)? ':' suite)+ ('else' ':' suite)? ('finally' ':' suite)?
  | 'try' ':' suite 'finally' ':' suite
  | 'match' stars ':' NL INDENT caseblock+ DEDENT ;
caseblock: 'case' patterns ('if' named)? ':' suite ;
patterns: pattern%',' ','? ;
pattern: orpat ('as' name)? | '*' name ;
orpat: closed%'|' ;
closed: '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | dotted | '(' patterns? ')' | '[' patterns? ']'
  | '{' (mapitem%',' ','?)? '}' | dotted '(' (argpat%',' ','?)? ')' ;
mapitem: ('-'? NUM | STR+ | dotted | 'None' | 'True' | 'False') ':' pattern | '**' name ;
argpat: pattern | name '=' pattern ;
forst: 'for' targets 'in' stars ':' suite ('else' ':' suite)? ;
targets: starop%',' ','? ;
withst: 'with' withitem%',' ':' suite | 'with' '(' withitem%',' ','? ')' ':' suite ;
withitem: test ('as' starop)? ;
decorator: '@' named NL ;
func: 'def' name tparams? '(' params? ')' ('->' test)? ':' suite ;
cls: 'class' name tparams? ('(' args? ')')? ':' suite ;
tparams: '[' tparam%',' ','? ']' ;
tparam: ('*' | '**')? name (':' test)? ('=' stars)? ;
params: param%',' ','? ;
param: name (':' stars)? ('=' test)? | '*' (name (':' stars)?)? | '**' name (':' test)? | '/' ;
lparams: lparam%',' ','? ;
lparam: name ('=' test)? | '*' name? | '**' name | '/' ;
stars: star%',' ','? ;
star: named | '*' chain ;
starop: chain | '*' chain ;
named: test | name ':=' test ;
test: chain ('if' chain 'else' test)? | 'lambda' lparams? ':' test ;
chain: unary%binop ;
binop: '+' | '-' | '*' | '/' | '//' | '%' | '@' | '<<' | '>>' | '&' | '^' | '|' | '**' | 'and' | 'or' | '<' | '>' | '<=' | '>=' | '==' | '!='
  | 'in' | 'not' 'in' | 'is' | 'is' 'not' ;
unary: ('not' | '-' | '+' | '~') unary | 'await'? atom trailer* ;
trailer: '(' args? ')' | '[' subs ']' | '.' name ;
args: arg%',' ','? ;
arg: named comp? | name '=' test | '*' test | '**' test ;
subs: sub%',' ','? ;
sub: named | '*' chain | test? ':' test? (':' test?)? ;
atom: name | NUM | STR+ | 'None' | 'True' | 'False' | '...' | '(' ')' | '(' stars ')' | '(' yields ')' | '(' named comp ')'
  | '[' ']' | '[' stars ']' | '[' named comp ']' | '{' '}' | '{' dictitem%',' ','? '}' | '{' stars '}' | '{' named comp '}' | '{' test ':' test comp '}' ;
dictitem: test ':' test | '**' chain ;
comp: ('async'? 'for' targets 'in' chain ('if' compif)*)+ ;
compif: chain | name ':=' chain | 'lambda' lparams? ':' test ;
"""

_ECMA = r"""
start: item* ;
item: stmt | import | export ;
stmt: block | var ';' | ';' | expr_s ';' | 'if' '(' expr ')' stmt | 'if' '(' expr ')' stmt 'else' stmt
  | 'for' 'await'? '(' forhead ')' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'do' stmt 'while' '(' expr ')'
  | ('continue' | 'break') id? ';' | 'return' expr? ';' | 'throw' expr ';' | 'debugger' ';'
  | 'try' block catch | 'try' block catch? 'finally' block
  | 'switch' '(' expr ')' '{' (('case' expr | 'default') ':' stmt*)* '}' | id ':' stmt | func | class
  %TS%
  ;
catch: 'catch' ('(' bind anno? ')')? block ;
block: '{' stmt* '}' ;
forhead: (var | expr)? ';' expr? ';' expr? | ('var' | 'let' | 'const') bind anno? ('of' assign | 'in' expr) | post ('of' assign | 'in' expr) ;
var: ('var' | 'let' | 'const') decl%',' ;
decl: bind '!'? anno? ('=' assign)? ;
bind: id | '[' (','* belem (','+ belem)* ','* | ','*) ']' | '{' (bprop%',' ','?)? '}' ;
belem: bind ('=' assign)? | '...' bind ;
bprop: id ('=' assign)? | pname ':' bind ('=' assign)? | '...' id ;
func: 'async'? 'function' '*'? id sig block ;
sig: tparams? '(' params? ')' ret? ;
params: param%',' ','? ;
param: decorator* mod* bind '?'? anno? ('=' assign)? | decorator* '...' bind anno? | 'this' anno ;
class: decorator* 'class' id tparams? heritage '{' member* '}' ;
heritage: ('extends' post targs?)? ;
member: ';' | decorator* mod* pname ('?' | '!')? anno? ('=' assign)? ';' | decorator* mod* 'async'? '*'? pname '?'? sig block
  | decorator* mod* ('get' | 'set') pname sig block | 'static' block
  %TSMEMBER%
  ;
decorator: '@' post ;
mod: 'static' | 'accessor' %TSMOD% ;
import: 'import' STR attrs? ';' | 'import' impclause 'from' STR attrs? ';' %TSIMPORT% ;
attrs: ('with' | 'assert') '{' ((id | STR) ':' STR)%',' ','? '}' ;
impclause: id | id ',' star | id ',' named | star | named ;
star: '*' 'as' id ;
named: '{' (spec%',' ','?)? '}' ;
spec: %TYPEQ% (anyname | STR) ('as' (anyname | STR))? ;
export: 'export' (var ';' | func | class) | 'export' named ('from' STR attrs?)? ';' | 'export' '*' ('as' (anyname | STR))? 'from' STR attrs? ';'
  | 'export' 'default' (anonfunc | anonclass | func | class | expr_s ';' | objlit ';')
  %TSEXPORT%
  ;
anonfunc: 'async'? 'function' '*'? sig block ;
anonclass: decorator* 'class' tparams? heritage '{' member* '}' ;
expr: assign%',' ;
expr_s: assign_s | expr_s ',' assign ;
assign: chain | post (AOP | '=') assign | chain '?' assign ':' assign | arrow | yield ;
assign_s: chain_s | post_s (AOP | '=') assign | chain_s '?' assign ':' assign | arrow | yield ;
yield: 'yield' '*'? assign | 'yield' ;
arrow: 'async'? arrowhead '=>' abody ;
arrowhead: id | parens %TSARROW% ;
abody: block | assign_s | func | class | anonfunc ;
chain: unary | chain binop unary ;
chain_s: unary_s | chain_s binop unary ;
binop: '+' | '-' | '*' | '/' | '%' | '**' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '<<' | '>' '>' | '>' '>' '>' | '&' | '|' | '^' | '&&' | '||' | '??' | 'in' | 'instanceof' ;
unary: post | post ('++' | '--') | pre unary %TSUNARY% ;
unary_s: post_s | post_s ('++' | '--') | pre unary %TSUNARYS% ;
pre: 'delete' | 'void' | 'typeof' | '+' | '-' | '~' | '!' | '++' | '--' | PREINC | 'await' ;
post: prim | post suffix | 'new' '.' id | 'new' post ;
post_s: prim_s | post_s suffix | 'new' '.' id | 'new' post ;
suffix: '.' member_name | '?.' member_name | '?.' callargs | '?.' '[' expr ']' | '[' expr ']' | callargs | template %TSSUFFIX% ;
member_name: anyname | PRIV ;
callargs: '(' ((assign | '...' assign)%',' ','?)? ')' ;
prim: prim_s | objlit | func | anonfunc | anonclass | class ;
prim_s: id | 'this' | 'super' | 'null' | 'true' | 'false' | NUM | STR | REGEX | PRIV | template | array | parens | 'import' callargs | 'import' '.' 'meta' %JSX% ;
parens: '(' (pitem%',' ','?)? ')' ;
pitem: assign | '...' bind ;
array: '[' (','* elem (','+ elem)* ','* | ','*) ']' ;
elem: assign | '...' assign ;
objlit: '{' (prop%',' ','?)? '}' ;
prop: id ('=' assign)? | pname ':' assign | '...' assign | 'async'? '*'? pname sig block | ('get' | 'set') pname sig block ;
pname: anyname | STR | NUM | '[' assign ']' | PRIV ;
template: TPL | TPLOPEN expr (TPLSEP expr)* TPLCLOSE ;
id: NAME | 'async' | 'of' | 'get' | 'set' | 'static' | 'as' | 'from' | 'accessor' | 'meta' | 'assert' | 'yield' | 'let' %TSID% ;
anyname: id_plain | 'let' | 'yield' | %KEYWORDS% ;
id_plain: NAME | 'async' | 'of' | 'get' | 'set' | 'static' | 'as' | 'from' | 'accessor' | 'meta' | 'assert' %TSID% ;
"""

#: Reserved words of ECMAScript, and the contextual ones that TypeScript adds.
ECMA_WORDS = (
    "await break case catch class const continue debugger default delete do else enum export extends false finally for function if import in"
    " instanceof new null return super switch this throw true try typeof var void while with"
).split()
TS_WORDS = (
    "type interface namespace module declare abstract readonly public private protected override is keyof infer unique asserts satisfies implements out global"
    " any require object never unknown string number boolean symbol bigint undefined"
).split()

_TS = r"""
tparams: '<' tparam%',' ','? '>' ;
tparam: ('const' | 'in' | 'out')* id ('extends' type)? ('=' type)? ;
targs: '<' type%',' ','? '>' ;
anno: ':' type ;
ret: ':' type ;
type: tun | tun 'extends' tun '?' type ':' type | functype | 'abstract'? 'new' functype | (id | 'this') 'is' type | 'asserts' (id | 'this') ('is' type)? ;
functype: tparams? '(' params? ')' '=>' type ;
tun: ('|' | '&')? tpost | tun ('|' | '&') tpost | tun ('|' | '&') functype ;
tpost: tprim | tpost '[' ']' | tpost '[' type ']' | ('keyof' | 'unique' | 'readonly') tpost | 'infer' id ('extends' tun)? | 'typeof' tname targs? | 'typeof' 'import' '(' STR ')' ;
tprim: tname targs? | STR | NUM | '-' NUM | ttemplate | 'null' | 'void' | 'this' | 'true' | 'false' | '{' tmember* lastmember? '}' | mapped
  | '[' (telem%',' ','?)? ']' | '(' type ')' | 'import' '(' STR ')' ('.' tname)? targs? ;
ttemplate: TPL | TPLOPEN type (TPLSEP type)* TPLCLOSE ;
tname: id | tname '.' anyname ;
telem: type | '...' type | (id | 'this') '?'? ':' type | '...' id ':' type | type '?' ;
tmember: lastmember (',' | ';') ;
lastmember: mod* pname '?'? anno? | mod* pname '?'? tparams? '(' params? ')' ret? | ('get' | 'set') pname '(' params? ')' ret?
  | tparams? '(' params? ')' ret? | 'new' tparams? '(' params? ')' ret? | mod* '[' id ':' type ']' anno ;
mapped: '{' (('+' | '-')? 'readonly')? '[' id 'in' type ('as' type)? ']' (('+' | '-')? '?')? anno? ';'? '}' ;
interface: 'interface' id tparams? ('extends' (post_t targs?)%',')? '{' tmember* lastmember? '}' ;
post_t: id | post_t '.' anyname ;
enum: 'const'? 'enum' id '{' (enumitem%',' ','?)? '}' ;
enumitem: pname ('=' assign)? ;
alias: 'type' id tparams? '=' type ';' ;
nspace: ('namespace' | 'module') (id%'.' | STR) '{' item* '}' ;
ambient: 'declare' (var ';' | 'async'? 'function' '*'? id sig ';' | 'abstract'? class | interface | enum | alias | nspace | 'module' STR ';' | 'global' '{' item* '}') ;
"""

_TS_PARTS = {
    "%TS%": "| interface | enum | alias | nspace | ambient | 'async'? 'function' '*'? id sig ';' | 'abstract' class",
    "%TSMEMBER%": "| decorator* mod* 'async'? '*'? pname '?'? sig ';' | decorator* mod* ('get' | 'set') pname sig ';' | mod* '[' id ':' type ']' anno ';'",
    "%TSMOD%": "| 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare'",
    "%TSIMPORT%": "| 'import' 'type' impclause 'from' STR attrs? ';' | 'import' 'type'? id '=' ('require' '(' STR ')' | tname) ';'",
    "%TYPEQ%": "'type'?",
    "%TSEXPORT%": "| 'export' (interface | enum | alias | nspace | ambient | 'abstract' class) | 'export' 'async'? 'function' '*'? id sig ';' | 'export' 'type' named ('from' STR attrs?)? ';'"
    " | 'export' 'type' '*' ('as' anyname)? 'from' STR ';' | 'export' 'default' (interface | 'abstract' class | 'abstract' anonclass) | 'export' '=' expr ';' | 'export' 'as' 'namespace' id ';'"
    " | 'export' 'import' id '=' ('require' '(' STR ')' | tname) ';' | 'export' 'default' 'async'? 'function' '*'? id? sig ';'",
    "%TSARROW%": "| tparams? '(' params? ')' ret?",
    "%TSUNARY%": "| unary ('as' | 'satisfies') (type | 'const') %CAST%",
    "%TSUNARYS%": "| unary_s ('as' | 'satisfies') (type | 'const') %CAST%",
    "%TSSUFFIX%": "| '!' | targs callargs | targs template | '?.' targs callargs | targs",
    "%TSID%": "".join(f" | '{w}'" for w in TS_WORDS),
}


def ecma(typed: bool, jsx: bool) -> str:
    g = _ECMA
    words = ECMA_WORDS
    parts = dict(_TS_PARTS) if typed else {k: "" for k in _TS_PARTS}
    for k, v in parts.items():
        g = g.replace(k, v)
    g = g.replace("%CAST%", "" if jsx else "| '<' (type | 'const') '>' unary").replace("%KEYWORDS%", " | ".join(f"'{w}'" for w in words))
    g = g.replace("%JSX%", "| jsx" if jsx else "")
    if typed:
        g = g.replace("heritage: ('extends' post targs?)? ;", "heritage: ('extends' post targs?)? ('implements' (post_t targs?)%',')? ;") + _TS
    else:
        for dead in ("tparams? ", " targs?", " ret?", " anno?", "mod* bind '?'?", " | 'this' anno"):
            g = g.replace(dead, "mod* bind" if dead.startswith("mod* bind") else "")
        g = g.replace("'=' assign)? | decorator* '...' bind", "'=' assign)? | '...' bind").replace("decl: bind '!'?", "decl: bind").replace("pname ('?' | '!')?", "pname").replace("pname '?'? sig", "pname sig").replace("param: decorator* mod* bind", "param: bind")
    if jsx:
        g += """
jsx: JOPEN jattr* JSELF | JOPEN jattr* JGT jchild* JCLOSE ;
jattr: JNAME ('=' (JSTR | JL assign JR | jsx))? | JL '...' assign JR ;
jchild: JTEXT | JL (expr | '...' assign)? JR | jsx ;
"""
    return g


GO = r"""
start: ';'* 'package' id ';' imports* (top ';')* (top)? ;
imports: 'import' (spec | '(' (spec%';')? ';'? ')') ';' ;
spec: ('.' | id)? STR ;
top: decl | 'func' (params)? id tparams? signature block? ;
tparams: '[' tparam%',' ','? ']' ;
tparam: id%',' constraint ;
constraint: cterm%'|' ;
cterm: '~'? type ;
decl: 'var' (varspec | '(' (varspec%';')? ';'? ')') | 'const' (constspec | '(' (constspec%';')? ';'? ')') | 'type' (typespec | '(' (typespec%';')? ';'? ')') ;
varspec: id%',' type ('=' exprs)? | id%',' '=' exprs ;
constspec: id%',' (type? '=' exprs)? ;
typespec: id tparams? '='? type ;
signature: params (params | type)? ;
params: '(' (param%',' ','?)? ')' ;
param: type | id type | id '...' type | '...' type ;
type: tname targs? | '*' type | '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | 'chan' type | 'chan' '<-' type | '<-' 'chan' type
  | 'func' signature | 'struct' '{' (field%';')? ';'? '}' | 'interface' '{' (imember%';')? ';'? '}' | '(' type ')' ;
tname: id | id '.' id ;
targs: '[' type%',' ','? ']' ;
field: id%',' type STR? | '*'? tname targs? STR? ;
imember: id signature | constraint ;
block: '{' stmts '}' ;
stmts: (stmt%';') ;
stmt: | simple | decl | 'return' exprs? | 'break' id? | 'continue' id? | 'goto' id | 'fallthrough' | block | id ':' stmt
  | ifst | 'switch' (simple_h? ';')? switchhead? '{' clause* '}' | 'select' '{' commclause* '}'
  | 'for' block | 'for' expr_h block | 'for' simple_h? ';' expr_h? ';' simple_h? block | 'for' (exprs_h ('=' | ':='))? 'range' expr_h block | 'go' expr | 'defer' expr ;
ifst: 'if' (simple_h? ';')? expr_h block ('else' (ifst | block))? ;
switchhead: expr_h | id ':=' expr_h ;
clause: ('case' exprs | 'case' type%',' | 'default') ':' stmts ;
commclause: ('case' simple | 'default') ':' stmts ;
simple: expr | expr '<-' expr | expr ('++' | '--') | exprs (AOP | '=' | ':=') exprs ;
simple_h: expr_h | expr_h '<-' expr_h | expr_h ('++' | '--') | exprs_h (AOP | '=' | ':=') exprs_h ;
exprs: expr%',' ;
exprs_h: expr_h%',' ;
expr: unary%binop ;
expr_h: unary_h%binop ;
binop: '+' | '-' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^' | '|' | '^' | '&&' | '||' | '==' | '!=' | '<' | '<=' | '>' | '>=' ;
unary: ('+' | '-' | '!' | '^' | '*' | '&' | '<-') unary | prim ;
unary_h: ('+' | '-' | '!' | '^' | '*' | '&' | '<-') unary_h | prim_h ;
prim: operand | prim suffix | littype lit | prim '{' elems? '}' ;
prim_h: operand | prim_h suffix | littype lit_h ;
lit_h: '{' elems? '}' ;
lit: '{' elems? '}' ;
littype: '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | 'struct' '{' (field%';')? ';'? '}' ;
suffix: '.' id | '.' '(' (type | 'type') ')' | '[' expr ']' | '[' type%',' ','? ']' | '[' expr? ':' expr? (':' expr)? ']' | '(' ((arg)%',' '...'? ','?)? ')' ;
arg: expr | typearg ;
typearg: '[' ']' type | 'map' '[' type ']' type | 'chan' type | 'struct' '{' (field%';')? ';'? '}' | 'interface' '{' (imember%';')? ';'? '}' | 'func' signature | '*' typearg | '<-' 'chan' type | 'chan' '<-' type ;
operand: id | NUM | STR | CHAR | 'func' signature block | '(' expr ')' | '(' typearg ')' | '[' ']' type | 'interface' '{' '}' ;
elems: elem%',' ','? ;
elem: (ev ':')? ev ;
ev: expr | '{' elems? '}' ;
id: NAME ;
"""

JAVA = r"""
start: unit | mods 'module' qname '{' (mdirective)* '}' ;
unit: (mods 'package' qname ';')? (import | ';')* (typedecl | ';')* ;
mdirective: ('requires' | 'exports' | 'opens' | 'uses' | 'provides') ('transitive' | 'static')* qname (('to' | 'with') qname%',')? ';' ;
import: 'import' 'static'? qname ('.' '*')? ';' ;
qname: id%'.' ;
mods: (annotation | mod)* ;
mod: 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | NONSEALED ;
annotation: '@' qname ('(' (annargs)? ')')? ;
annargs: annval | (id '=' annval)%',' ;
annval: ternary | annotation | '{' (annval%',')? ','? '}' ;
typedecl: mods (classdecl | 'interface' id tparams? ('extends' type%',')? ('permits' type%',')? body | enumdecl | '@' 'interface' id annbody | recorddecl) ;
classdecl: 'class' id tparams? ('extends' type)? ('implements' type%',')? ('permits' type%',')? body ;
recorddecl: 'record' id tparams? '(' (rparam%',')? ')' ('implements' type%',')? body ;
rparam: annotation* type '...'? id ;
enumdecl: 'enum' id ('implements' type%',')? '{' (econst%',')? ','? (';' member*)? '}' ;
econst: annotation* id args? body? ;
body: '{' member* '}' ;
annbody: '{' (annmember)* '}' ;
annmember: mods type id '(' ')' dims ('default' annval)? ';' | mods type vdecl%',' ';' | typedecl | ';' ;
member: ';' | 'static'? block | typedecl | mods tparams? (type | 'void') id '(' params? ')' dims throws? (block | ';') | mods tparams? id '(' params? ')' throws? block | mods id block | mods type vdecl%',' ';' ;
throws: 'throws' type%',' ;
params: param%',' ;
param: mods type (annotation* '...')? (id dims | (id '.')? 'this') ;
dims: (annotation* '[' ']')* ;
tparams: '<' tparam%',' '>' ;
tparam: annotation* id ('extends' type%'&')? ;
type: annotation* (ctype | PRIM) dims ;
ctype: id targs? | ctype '.' annotation* id targs? ;
targs: '<' (targ%',')? '>' ;
targ: type | annotation* '?' (('extends' | 'super') type)? ;
vdecl: id dims ('=' (expr | arrayinit))? ;
arrayinit: '{' ((expr | arrayinit)%',')? ','? '}' ;
block: '{' bstmt* '}' ;
bstmt: stmt | mods type vdecl%',' ';' | typedecl_local ;
typedecl_local: mods (classdecl | 'interface' id tparams? ('extends' type%',')? body | enumdecl | recorddecl) ;
stmt: block | ';' | stmtexpr ';' | 'if' '(' expr ')' stmt | 'if' '(' expr ')' stmt 'else' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' forinit? ';' expr? ';' (stmtexpr%',')? ')' stmt | 'for' '(' mods type id dims ':' expr ')' stmt | 'return' expr? ';' | 'throw' expr ';' | 'yield' expr ';'
  | ('break' | 'continue') id? ';' | 'synchronized' '(' expr ')' block | 'assert' expr (':' expr)? ';' | id ':' stmt | switch
  | 'try' resources? block catch* ('finally' block)? ;
resources: '(' resource%';' ';'? ')' ;
resource: mods type id '=' expr | post ;
catch: 'catch' '(' mods ctype%'|' id ')' block ;
forinit: mods type vdecl%',' | stmtexpr%',' ;
switch: 'switch' '(' expr ')' '{' sgroup* '}' ;
sgroup: label ':' bstmt* | label '->' (expr ';' | block | 'throw' expr ';') ;
label: 'case' (ternary | pattern)%',' | 'default' ;
pattern: mods type id ;
stmtexpr: post '.' creator | post AOP expr | post '=' expr | post ('++' | '--') | ('++' | '--') unary | call | creator ;
call: post args | qargs ;
qargs: post '.' targs id args | 'this' args | 'super' args ;
expr: ternary | post ('=' | AOP) expr | lambda ;
lambda: (id | '(' ')' | '(' id%',' ')' | '(' params ')') '->' (expr | block) ;
ternary: chain ('?' expr ':' (ternary | lambda))? ;
chain: unary | chain binop unary | chain 'instanceof' mods (type id?) ;
binop: '+' | '-' | '*' | '/' | '%' | '<<' | '<' | '>' | '>' '>' | '>' '>' '>' | '<=' | '>=' | '==' | '!=' | '&' | '|' | '^' | '&&' | '||' ;
unary: post | post ('++' | '--') | ('+' | '-' | '!' | '~' | '++' | '--') unary | '(' type%'&' ')' unary | '(' type%'&' ')' lambda | switch ;
post: prim | post '.' id | post '.' 'class' | post '.' 'this' | post '.' 'super' | post '[' expr ']' | post args | post '.' targs (id | 'super') args | post '.' creator
  | post '::' targs? (id | 'new') | type '::' targs? (id | 'new') ;
prim: id | LIT | NUM | STR | 'this' | 'super' | '(' expr ')' | creator | PRIM dims '.' 'class' | ctype dim1 '.' 'class' | 'void' '.' 'class' ;
dim1: ('[' ']')+ ;
creator: 'new' annotation* targs? ctype (args body? | adims arrayinit?) | 'new' annotation* PRIM adims arrayinit? ;
adims: (annotation* '[' expr? ']')+ ;
args: '(' (expr%',')? ')' ;
id: NAME | 'module' | 'requires' | 'exports' | 'opens' | 'uses' | 'provides' | 'transitive' | 'to' | 'with' | 'sealed' | 'permits' | 'record' | 'yield' ;
"""

RUST = r"""
start: innerattr* item* ;
innerattr: '#' '!' '[' tree* ']' | DOCIN ;
attr: '#' '[' tree* ']' ;
item: attr* vis? itemkind | attr* macroitem ;
vis: 'pub' ('(' ('crate' | 'self' | 'super' | 'in' path) ')')? ;
itemkind: 'mod' id (';' | '{' innerattr* item* '}') | 'unsafe'? 'extern' STR? '{' innerattr* item* '}' | 'extern' 'crate' (id | 'self') ('as' id)? ';' | 'use' usetree ';'
  | fn | 'type' id generics? (':' bounds)? where? ('=' type)? where? ';' | ('struct' | 'union') id generics? structbody | 'enum' id generics? where? '{' (variant%',' ','?)? '}'
  | 'const' (id | '_') ':' type ('=' expr)? ';' | 'static' 'mut'? id ':' type ('=' expr)? ';'
  | 'unsafe'? 'auto'? 'trait' id generics? (':' bounds?)? where? '{' innerattr* item* '}' | 'unsafe'? 'impl' generics? 'const'? '!'? type ('for' type)? where? '{' innerattr* item* '}' ;
macroitem: path '!' id? (tt_paren ';' | tt_brack ';' | tt_brace) ;
usetree: '::'? usepath ;
usepath: (pseg '::')* (pseg ('as' (id | '_'))? | '*' | '{' (usetree%',' ','?)? '}') ;
pseg: id | 'crate' | 'self' | 'super' | 'Self' ;
fn: 'default'? 'const'? 'async'? 'unsafe'? ('extern' STR?)? 'fn' id generics? '(' (fnparam%',' ','?)? ')' ('->' type)? where? (block | ';') ;
fnparam: attr* selfparam | attr* pat ':' type | attr* pat ':' '...' | attr* '...' ;
selfparam: ('&' LIFE?)? 'mut'? 'self' (':' type)? ;
generics: '<' (gparam%',' ','?)? '>' ;
gparam: attr* LIFE (':' (LIFE%'+')? '+'?)? | attr* id (':' bounds?)? ('=' type)? | attr* 'const' id ':' type ('=' (LITNUM | STR | id | block))? ;
where: 'where' (wclause%',' ','?)? ;
wclause: LIFE ':' LIFE%'+' | ('for' generics)? type ':' bounds? ;
bounds: bound%'+' '+'? ;
bound: LIFE | '?'? ('for' generics)? path | '(' '?'? ('for' generics)? path ')' ;
structbody: where? '{' (sfield%',' ','?)? '}' | '(' (tfield%',' ','?)? ')' where? ';' | where? ';' ;
sfield: attr* vis? id ':' type ;
tfield: attr* vis? type ;
variant: attr* vis? id ('{' (sfield%',' ','?)? '}' | '(' (tfield%',' ','?)? ')')? ('=' expr)? ;
type: path | '&' LIFE? 'mut'? type1 | '&&' LIFE? 'mut'? type1 | '*' ('const' | 'mut') type1 | '[' type ']' | '[' type ';' expr ']' | '(' ')' | '(' type%',' ','? ')' | '!' | '_'
  | 'impl' bounds | 'dyn' bounds | ('for' generics)? 'unsafe'? ('extern' STR?)? 'fn' '(' (fnarg%',' ','?)? ')' ('->' type)? | qpath | path '!' tt_any ;
type1: type ;
fnarg: attr* ((id | '_') ':')? type | '...' ;
path: '::'? tseg%'::' ;
tseg: pseg | pseg gargs | pseg '::' gargs | pseg '(' (type%',' ','?)? ')' ('->' type)? ;
gargs: '<' (garg%',' ','?)? '>' ;
garg: LIFE | type | LITNUM | '-' LITNUM | STR | 'true' | 'false' | block | id gargs? '=' type | id gargs? ':' bounds ;
qpath: '<' type ('as' path)? '>' ('::' tseg)+ ;
epath: '::'? eseg%'::' | '<' type ('as' path)? '>' ('::' eseg)+ ;
eseg: pseg | gargs_e ;
gargs_e: gargs ;
block: '{' innerattr* bstmt* tail? '}' ;
bstmt: ';' | item_s | attr* 'let' pat (':' type)? ('=' expr ('else' block)?)? ';' | attr* expr_s ';' | attr* blocklike | attr* macro_brace ;
item_s: item ;
tail: attr* expr_s ;
macro_brace: path '!' tt_brace ;
blocklike: (LIFE ':')? (block | 'unsafe' block | 'async' 'move'? block | 'const' block | ifx | 'match' expr_n '{' innerattr* (arm)* lastarm? '}' | 'loop' block | 'while' cond block | 'for' pat 'in' expr_n block) ;
ifx: 'if' cond block ('else' (block | ifx))? ;
cond: condpart%'&&' ;
condpart: expr_n | 'let' pat '=' scrut ;
scrut: un_n%binop_lazyless ;
arm: armhead '=>' (expr ',' | blocklike ','?) ;
lastarm: armhead '=>' expr ;
armhead: attr* pat ('if' cond)? ;
expr: chain | post_any AOP expr | post_any '=' expr | range | jump | closure ;
jump: 'return' expr? | 'break' LIFE? expr? | 'continue' LIFE? | 'yield' expr? ;
range: chain? ('..' | '..=') chain? ;
post_any: un ;
closure: 'static'? 'async'? 'move'? ('||' | '|' (cparam%',' ','?)? '|') (expr | '->' type block) ;
cparam: attr* pat1 (':' type)? ;
chain: un | chain binop un | chain binop closure | chain binop jump | chain 'as' type ;
binop: '+' | '-' | '*' | '/' | '%' | '<<' | '>' '>' | '&' | '|' | '^' | '&&' | '||' | '==' | '!=' | '<' | '>' | '<=' | '>=' ;
binop_lazyless: '+' | '-' | '*' | '/' | '%' | '<<' | '>' '>' | '&' | '|' | '^' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '..' | '..=' ;
un: ('-' | '!' | '*') un | ('&' | '&&') ('mut' | 'raw' ('const' | 'mut'))? un | post ;
post: prim | post suffix ;
suffix: '.' (id | 'await') | '.' LITNUM | '.' id '::' gargs | '(' (aexpr%',' ','?)? ')' | '[' expr ']' | '?' ;
aexpr: attr* expr ;
prim: lit | epath | epath '{' (finit%',' ','?)? base? '}' | '(' ')' | '(' aexpr%',' ','? ')' | '[' (aexpr%',' ','?)? ']' | '[' expr ';' expr ']' | blocklike | path '!' tt_any ;
base: '..' expr? ;
finit: attr* (id | LITNUM) ':' expr | attr* id ;
lit: LITNUM | STR | CHAR | 'true' | 'false' ;
expr_s: chain_s | un_s AOP expr | un_s '=' expr | chain_s ('..' | '..=') chain? | ('..' | '..=') chain? | jump | closure | blocklike suffix_dot suffix* (binop un)* | blocklike suffix_dot suffix* (AOP | '=') expr ;
suffix_dot: '.' (id | 'await') | '.' LITNUM | '.' id '::' gargs | '?' ;
chain_s: un_s | chain_s binop un | chain_s binop closure | chain_s binop jump | chain_s 'as' type | blocklike ;
un_s: ('-' | '!' | '*') un | ('&' | '&&') ('mut' | 'raw' ('const' | 'mut'))? un | post_s ;
post_s: prim_s | post_s suffix ;
prim_s: lit | epath | epath '{' (finit%',' ','?)? base? '}' | '(' ')' | '(' aexpr%',' ','? ')' | '[' (aexpr%',' ','?)? ']' | '[' expr ';' expr ']' | path '!' tt_any ;
expr_n: chain_n | un_n AOP expr_n | un_n '=' expr_n | chain_n? ('..' | '..=') chain_n? | jump_n | closure ;
jump_n: 'return' expr_n? | 'break' LIFE? expr_n? | 'continue' LIFE? ;
chain_n: un_n | chain_n binop un_n | chain_n 'as' type ;
un_n: ('-' | '!' | '*') un_n | ('&' | '&&') ('mut' | 'raw' ('const' | 'mut'))? un_n | post_n ;
post_n: prim_n | post_n suffix ;
prim_n: lit | epath | '(' ')' | '(' aexpr%',' ','? ')' | '[' (aexpr%',' ','?)? ']' | '[' expr ';' expr ']' | blocklike | path '!' tt_any ;
pat: '|'? pat1%'|' ;
pat1: 'ref'? 'mut'? id ('@' pat1)? | '_' | '..' | '-'? lit | patpath | ('-'? lit | patpath) ('..=' | '..' | '...') ('-'? lit | patpath)? | ('..=' | '..') ('-'? lit | patpath)
  | ('&' | '&&') 'mut'? pat1 | '(' (pat%',' ','?)? ')' | '[' (pat%',' ','?)? ']' | patpath '(' (pat%',' ','?)? ')' | patpath '{' (fpat%',' ','?)? '}' | path '!' tt_any | 'box' pat1 | 'const' block ;
patpath: epath ;
fpat: attr* (id | LITNUM) ':' pat | attr* 'box'? 'ref'? 'mut'? id | attr* '..' ;
tt_any: tt_paren | tt_brack | tt_brace ;
tt_paren: '(' tree* ')' ;
tt_brack: '[' tree* ']' ;
tt_brace: '{' tree* '}' ;
tree: tt_any | %TREES% ;
id: NAME | 'union' | 'auto' | 'default' | 'raw' ;
"""
#: Every token but brackets may stand in a Rust macro's argument.
_RUST_TREES = (
    "NAME STR CHAR LITNUM LIFE AOP DOCIN 'union' 'auto' 'default' 'raw' 'box' 'as' 'async' 'await' 'break' 'const' 'continue' 'crate' 'dyn' 'else' 'enum' 'extern' 'false' 'fn' 'for' 'if' 'impl' 'in' 'let' 'loop' 'match' 'mod' 'move' 'mut'"
    " 'pub' 'ref' 'return' 'self' 'Self' 'static' 'struct' 'super' 'trait' 'true' 'type' 'unsafe' 'use' 'where' 'while' 'yield' '_' ';' ',' '.' '..' '...' '..=' ':' '::' '->' '=>' '#' '$' '?' '~' '@' '!' '=' '=='"
    " '!=' '<' '>' '<=' '>=' '+' '-' '*' '/' '%' '^' '&' '|' '&&' '||' '<<'"
).split()
RUST = RUST.replace("%TREES%", " | ".join(_RUST_TREES))
