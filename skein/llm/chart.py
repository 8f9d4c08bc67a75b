"""An error-correcting chart parser for the lexemes of JavaScript and TypeScript.

Bracketed groups are interned by their content, so equal groups anywhere are one number, and parsed once for
each role they are used in (block, object, parameters, ...). A group's content is split at its semicolons; each
piece is a short sequence in which inner groups are single symbols. A piece is parsed by a chart of items
(rule, dot, origin) with prediction limited to what the next lexeme can begin. If that gives no parse, the cheapest
one with edits counts: a lexeme may be inserted, deleted or replaced for a cost of one each (brackets count with
what is in them). Short pieces are repaired by the tables of ``repairs``, long ones by the same chart with a bound on
the edits that is raised until there is a parse. Results are kept by content, within bounds.
"""

from __future__ import annotations

import numpy as np

from skein.functions.lexer import CONTEXTUAL, KEYWORDS, Group
from skein.llm.repairs import Repairs

#: Alternatives are separated by two semicolons; those after @ts are for TypeScript, after @cast for it without mark-up.
GRAMMAR = r"""
Program → ;; Items ;; Items OpenItem ;; OpenItem
Items → Item ;; Items Item
Item → NL ;; Closed ;; ModuleClosed
OpenItem → Open ;; ModuleOpen
Block → ;; Stmts ;; Stmts Open ;; Open
Stmts → Stmt ;; Stmts Stmt
Stmt → NL ;; Closed
Switch → ;; Cases ;; Cases Open ;; Open
Cases → CaseItem ;; Cases CaseItem
CaseItem → NL ;; Closed ;; case Expr : ;; default :
nl → ;; NL

Closed → {Block} ;; if (Cond) nl Closed ;; if (Cond) nl Closed nl else Closed ;; if (Cond) nl Open else Closed ;; Loop nl Closed ;; with (Cond) Closed ;; try {Block} Catch ;; switch (Cond) {Switch} ;; Func ;; Class ;; ID : nl Closed ;; Open NL ;; do nl Closed nl while (Cond) ;; do nl Open nl while (Cond)
Closed → @ts interface ID TParams IExt {Members} ;; @ts enum ID {Enum} ;; @ts const enum ID {Enum} ;; @ts declare Closed ;; @ts namespace Dotted {Program} ;; @ts module Dotted {Program} ;; @ts module STR {Program} ;; @ts global {Program}
Loop → for (For) ;; for await (ForAwait) ;; while (Cond)
Catch → catch (Catch1) {Block} ;; catch {Block} ;; finally {Block} ;; catch (Catch1) {Block} finally {Block} ;; catch {Block} finally {Block}
Open → Plain ;; VarDecl ;; return ;; return Expr ;; throw Expr ;; break ;; break ID ;; continue ;; continue ID ;; debugger ;; if (Cond) nl Open ;; if (Cond) nl Closed nl else Open ;; if (Cond) nl Open else Open ;; Loop ;; Loop nl Open ;; ID : nl Open ;; do nl Closed nl while (Cond) ;; do nl Open nl while (Cond)
Open → @ts type ID TParams = Type ;; @ts declare Open ;; @ts FuncHead ;; @ts import ID = Expr ;; @ts abstract Class
Plain → Expr
Dotted → ID ;; Dotted . NAME
IExt → ;; extends TypeList
TypeList → Type ;; TypeList , Type

ModuleClosed → export Func ;; export Class ;; export default AnyFunc ;; export default ClassExpr ;; Decs export Class ;; @ts export default abstract Class ;; @ts export interface ID TParams IExt {Members} ;; @ts export default interface ID TParams IExt {Members} ;; @ts export enum ID {Enum} ;; @ts export const enum ID {Enum} ;; @ts export declare Closed ;; @ts export namespace Dotted {Program} ;; @ts export abstract Class ;; ModuleOpen NL
ModuleOpen → import STR With ;; import Clause from STR With ;; @ts import type Clause from STR With ;; export {Names} ;; export {Names} from STR With ;; export * from STR ;; export * as NAME from STR ;; export VarDecl ;; export default NoBrace ;; export default {Object}
ModuleOpen → @ts export type ID TParams = Type ;; @ts export type {Names} ;; @ts export type {Names} from STR ;; @ts export = Expr ;; @ts export declare Open ;; @ts export FuncHead ;; @ts export as namespace ID ;; @ts export import ID = Expr
With → ;; with {Object}
Clause → ID ;; {Names} ;; * as ID ;; ID , {Names} ;; ID , * as ID
Names → ;; NameList ;; NameList ,
NameList → Name1 ;; NameList , Name1
Name1 → NAME ;; NAME as NAME ;; STR as NAME ;; NAME as STR ;; @ts type NAME ;; @ts type NAME as NAME

VarDecl → var Bindings ;; let Bindings ;; const Fixed ;; @ts using Fixed ;; @ts await using Fixed
VarWord → var ;; let ;; const ;; @ts using
Bindings → Binding ;; Bindings , Binding
Binding → ID Annot Init ;; {Pattern} Annot = Assign ;; [ListPattern] Annot = Assign ;; @ts ID ! : Type ;; @ts {Pattern} : Type ;; @ts [ListPattern] : Type
Fixed → Fast ;; Fixed , Fast
Fast → Target Annot = Assign ;; @ts ID : Type
Target → ID ;; {Pattern} ;; [ListPattern]
Init → ;; = Assign
Annot → ;; @ts : Type

Func → FuncHead {Block}
FuncHead → function ID TParams (Params) Ret ;; function * ID TParams (Params) Ret ;; async function ID TParams (Params) Ret ;; async function * ID TParams (Params) Ret
AnyFunc → function Opt_ID TParams (Params) Ret {Block} ;; function * Opt_ID TParams (Params) Ret {Block} ;; async function Opt_ID TParams (Params) Ret {Block} ;; async function * Opt_ID TParams (Params) Ret {Block}
Opt_ID → ;; ID
Ret → ;; @ts : RetType
RetType → Type ;; ID is Type ;; this is Type ;; asserts ID ;; asserts ID is Type ;; asserts this ;; asserts this is Type
TParams → ;; @ts < TParamList > ;; @ts < TParamList , >
TParamList → TParam ;; TParamList , TParam
TParam → TVar ;; TVar extends Type ;; TVar = Type ;; TVar extends Type = Type
TVar → ID ;; const ID ;; in ID ;; out ID
Class → class ID TParams Heritage {Class1} ;; Decs class ID TParams Heritage {Class1} ;; @ts abstract class ID TParams Heritage {Class1} ;; @ts Decs abstract class ID TParams Heritage {Class1}
ClassExpr → class Opt_ID TParams Heritage {Class1} ;; Decs class Opt_ID TParams Heritage {Class1}
Heritage → ;; extends Lhs ;; @ts extends Lhs TArgs ;; @ts extends Lhs implements TypeList ;; @ts extends Lhs TArgs implements TypeList ;; @ts implements TypeList
Decs → Dec ;; Decs Dec
Dec → @ DecExpr nl
DecExpr → ID ;; DecExpr . NAME ;; DecExpr (Args) ;; (Paren)
Class1 → ;; Membs ;; Membs OpenMemb ;; OpenMemb
Membs → Memb ;; Membs Memb
Memb → NL ;; Mods MKind Key Opt TParams (Params) Ret {Block} ;; OpenMemb NL ;; static {Block}
Mods → ;; Mods Mod
Mod → static ;; accessor ;; Dec ;; @ts public ;; @ts private ;; @ts protected ;; @ts abstract ;; @ts readonly ;; @ts override ;; @ts declare
MKind → ;; get ;; set ;; async ;; * ;; async *
OpenMemb → Mods Key Opt Annot Init ;; @ts Mods MKind Key Opt TParams (Params) Ret ;; @ts Mods [Index] : Type
Opt → ;; @ts ? ;; @ts !
Key → NAME ;; STR ;; NUM ;; PRIV ;; [Computed]

Object → ;; Props ;; Props ,
Props → Prop ;; Props , Prop
Prop → ID ;; Key : Assign ;; ... Assign ;; MKind Key TParams (Params) Ret {Block}
Pattern → ;; Pats ;; Pats ,
Pats → Pat ;; Pats , Pat
Pat → ID Init ;; Key : Target Init ;; ... Target
Array → Elems
Elems → Elem ;; Elems , Elem
Elem → ;; Assign ;; ... Assign
ListPattern → LPats
LPats → LPat ;; LPats , LPat
LPat → ;; Target Init ;; ... Target
Params → ;; ParamList ;; ParamList ,
ParamList → Param ;; ParamList , Param
Param → PMods Target Annot Init ;; ... Target Annot ;; @ts PMods Target ? Annot ;; @ts this : Type
PMods → ;; Decs ;; @ts PMods PMod
PMod → public ;; private ;; protected ;; readonly ;; override
Args → ;; ArgList ;; ArgList ,
ArgList → Arg ;; ArgList , Arg
Arg → Assign ;; ... Assign
Paren → Expr
Cond → Expr
Index → @ts ID : Type ;; @ts ID in Type ;; @ts ID in Type as Type ;; Expr
Computed → Assign
Catch1 → Target Annot
For → ForInit ; Opt_Expr ; Opt_Expr ;; VarWord Target of Assign ;; VarWord Target Annot in Expr ;; Aim of Assign ;; Aim in Expr
ForAwait → VarWord Target of Assign ;; Aim of Assign
Aim → Ref ;; {AimPattern} ;; [AimList]
AimPattern → ;; AimProps ;; AimProps ,
AimProps → AimProp ;; AimProps , AimProp
AimProp → ID Init ;; Key : Aim Init ;; ... Aim
AimList → AimElems
AimElems → AimElem ;; AimElems , AimElem
AimElem → ;; Aim Init ;; ... Aim
ForInit → ;; Expr ;; VarDecl
Opt_Expr → ;; Expr
Subst → Expr
Embed → ;; Expr ;; ... Assign

Expr → Assign ;; Expr , Assign
Assign → Bin ;; Bin ? Assign : Assign ;; Ref AOp Assign ;; {AimPattern} = Assign ;; [AimList] = Assign ;; Arrow ;; yield ;; yield Assign ;; yield * Assign
NoBrace → Assign
Arrow → ArrowHead => {Block} ;; ArrowHead => NoBrace
ArrowHead → ID ;; async ID ;; TParams (Params) Ret ;; async TParams (Params) Ret
AOp → = ;; += ;; -= ;; *= ;; /= ;; %= ;; **= ;; <<= ;; >>= ;; >>>= ;; &= ;; |= ;; ^= ;; &&= ;; ||= ;; ??=
Bin → Un ;; Bin BOp Un ;; PRIV in Un ;; @ts Bin as Type ;; @ts Bin as const ;; @ts Bin satisfies Type
BOp → || ;; && ;; ?? ;; | ;; ^ ;; & ;; == ;; != ;; === ;; !== ;; < ;; > ;; <= ;; >= ;; instanceof ;; in ;; << ;; >> ;; >>> ;; + ;; - ;; * ;; / ;; % ;; ** ;; @ts > > ;; @ts > > >
Un → Post ;; UOp Un ;; @cast < Type > Un
UOp → delete ;; void ;; typeof ;; + ;; - ;; ~ ;; ! ;; ++ ;; -- ;; await
Post → Lhs ;; Ref ++ ;; Ref --
Ref → ID ;; Lhs . NAME ;; Lhs . PRIV ;; Lhs [Index1] ;; (Paren) ;; @ts Ref ! ;; @cast < Type > Ref
Lhs → Prim ;; Lhs . NAME ;; Lhs . PRIV ;; Lhs ?. NAME ;; Lhs ?. PRIV ;; Lhs [Index1] ;; Lhs ?. [Index1] ;; Lhs (Args) ;; Lhs ?. (Args) ;; Lhs TPL ;; @ts Lhs ! ;; @ts Lhs TArgs (Args) ;; @ts Lhs ?. TArgs (Args) ;; @ts Lhs TArgs TPL
Index1 → Expr
Prim → ID ;; NUM ;; STR ;; TPL ;; RE ;; this ;; super ;; null ;; true ;; false ;; [Array] ;; {Object} ;; (Paren) ;; AnyFunc ;; ClassExpr ;; JSX ;; new Lhs ;; @ts new Lhs TArgs ;; new . ID ;; import (Args) ;; import . NAME

Type → Union ;; TParams (Params) => RetType ;; new TParams (Params) => Type ;; abstract new TParams (Params) => Type ;; Union extends Type ? Type : Type
Union → Inter ;; | Inter ;; Union | Inter
Inter → TPost ;; & TPost ;; Inter & TPost
TPost → TPrim ;; TPost [TIndex] ;; keyof TPost ;; unique TPost ;; readonly TPost ;; infer ID ;; infer ID extends TPost
TPrim → Dotted ;; Dotted TArgs ;; STR ;; NUM ;; - NUM ;; TPL ;; true ;; false ;; null ;; this ;; void ;; typeof Dotted ;; typeof Dotted TArgs ;; typeof import (Args) ;; import (Args) ;; TPrim . NAME ;; {Members} ;; [Tuple] ;; (PType)
TArgs → < TypeList >
TIndex → ;; Type
PType → Type
Tuple → ;; TupleList ;; TupleList ,
TupleList → TElem ;; TupleList , TElem
TElem → Type ;; Type ? ;; ... Type ;; ID : Type ;; ID ? : Type ;; ... ID : Type
Members → ;; MemList ;; MemList Sep ;; Sep MemList
MemList → Mem ;; MemList Sep Mem
Sep → , ;; NL ;; , NL
Mem → MMods Key MOpt Annot ;; MKind Key MOpt TParams (Params) Ret ;; TParams (Params) Ret ;; new TParams (Params) Ret ;; MMods [Index] MapOpt : Type
MMods → ;; readonly ;; + readonly ;; - readonly
MOpt → ;; ?
MapOpt → ;; ? ;; - ? ;; + ?
Enum → ;; EnumList ;; EnumList ,
EnumList → EnumItem ;; EnumList , EnumItem
EnumItem → Key Init
"""

#: Roles whose content is split at semicolons.
SPLIT = frozenset(("Program", "Block", "Switch", "Class1", "Members"))
#: Not predicted where one of these stands: an expression that makes a statement, or the body of a function, doesn't begin so.
NOT_AT = {"Plain": frozenset(("{", "function", "class")), "NoBrace": frozenset(("{",))}
MOST_KEPT = 300_000
#: Lexemes up to which a piece is repaired by tables, which take the cube of its length whatever the edits; longer ones by charts, which grow with the edits. Both give the same.
SHORT = 100
#: Edits up to which charts are tried first for longer ones, and the length from which tables are too large for a worker.
FEW, LONG = 3, 600
FAR = 10**9
#: Spans of which tables are made at a time; each takes some KB.
SPANS = 8192
#: Lexemes before the one where the plain parse stops in which an edit is sought first.
NEAR = 12


class Grammar:
    """Rules of one dialect as states: a state is a position in a rule; its successor is the next number."""

    def __init__(self, typed: bool, markup: bool) -> None:
        rules: list[tuple[str, list[str]]] = []
        for line in GRAMMAR.split("\n"):
            left, arrow, right = line.partition("→")
            if not arrow:
                continue
            for part in f" {right} ".split(" ;; "):
                words = part.split()
                if words and words[0] in ("@ts", "@cast"):
                    if not typed or words[0] == "@cast" and markup:
                        continue
                    words = words[1:]
                rules.append((left.strip(), words))
        self.names = {left for left, _ in rules}
        self.next: list[str | None] = []
        self.left: list[str] = []
        self.rules: dict[str, list[int]] = {n: [] for n in self.names}
        self.body: dict[int, list[str]] = {}
        for left, words in rules:
            first = len(self.next)
            self.rules[left].append(first)
            self.body[first] = words
            for w in [*words, None]:
                self.next.append(w)
                self.left.append(left)
        self.starts = {s for own in self.rules.values() for s in own}
        self.nullable = self._fixed(lambda null: {a for a, w in rules if all(x in null for x in w)})
        first: dict[str, set[str]] = {n: set() for n in self.names}
        grown = True
        while grown:
            grown = False
            for left, words in rules:
                for w in words:
                    new = first[w] if w in self.names else {w}
                    if not new <= first[left]:
                        first[left] |= new
                        grown = True
                    if w not in self.nullable:
                        break
        self.first = first
        self.predicted: dict[tuple[str, object], list[int]] = {}
        inf = 10**6
        cost = dict.fromkeys(self.names, inf)
        for _ in range(60):
            for left, words in rules:
                cost[left] = min(cost[left], sum(cost[w] if w in self.names else self.lexemes(w, cost) for w in words))
        self.least = cost
        self.weight = {w: self.lexemes(w, cost) for w in self.next if w and w not in self.names}
        self.roles = {w[1:-1] for w in self.weight if self.lexemes(w, cost) > 1} | {"Program", "Subst", "Embed"}
        self.reached: dict[str, frozenset] = {}
        self.repairs = Repairs(self.rules, self.body, self.least, self.weight, NOT_AT)

    def reach(self, role: str) -> frozenset:
        """Terminals that occur in texts of a role."""
        out = self.reached.get(role)
        if out is None:
            todo, names, found = [role], {role}, set()
            while todo:
                for w in {w for s in self.rules[todo.pop()] for w in self.body[s]}:
                    if w not in self.names:
                        found.add(w)
                    elif w not in names:
                        names.add(w)
                        todo.append(w)
            out = self.reached[role] = frozenset(found)
        return out

    @staticmethod
    def lexemes(terminal: str, least: dict[str, int]) -> int:
        """Of how many lexemes the shortest text for a terminal is."""
        return 2 + least[terminal[1:-1]] if len(terminal) > 2 and terminal[0] + terminal[-1] in ("()", "[]", "{}") else 1

    @staticmethod
    def _fixed(step):
        known: set[str] = set()
        while (more := known | step(known)) != known:
            known = more
        return known

    def begin(self, name: str, look: object) -> list[int]:
        """States to predict for a name before a lexeme that stands for the terminals ``look`` (None: any)."""
        key = (name, look)
        out = self.predicted.get(key)
        if out is None:
            out = []
            if not (look is not None and name in NOT_AT and NOT_AT[name] & look):
                for s in self.rules[name]:
                    useful, empty = look is None, True
                    for w in self.body[s]:
                        if look is not None and (self.first[w] if w in self.names else {w}) & look:
                            useful = True
                        if w not in self.nullable:
                            empty = False
                            break
                    if useful or empty:
                        out.append(s)
            self.predicted[key] = out
        return out


class Parser:
    """Parses groups of lexemes in one dialect; keeps what it has found by content."""

    def __init__(self, typed: bool, markup: bool) -> None:
        self.grammar = Grammar(typed, markup)
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.content: list[tuple[str, tuple]] = []
        self.known: dict[tuple, bool] = {}
        self.looks: dict[object, frozenset] = {}

    def intern(self, group: Group) -> int:
        """The number of a group's content; inner groups first, without recursion."""
        order, todo = [], [group]
        while todo:
            g = todo.pop()
            order.append(g)
            todo.extend(k for k in g.kinds if isinstance(k, Group))
        done: dict[int, int] = {}
        for g in reversed(order):
            key = (g.open, tuple(done[id(k)] if isinstance(k, Group) else k for k in g.kinds))
            number = self.numbers.get(key)
            if number is None:
                number = self.numbers[key] = len(self.content)
                self.content.append(key)
            done[id(g)] = number
        return done[id(group)]

    def look(self, token: object) -> frozenset:
        """The terminals that a lexeme can stand for."""
        out = self.looks.get(token)
        if out is None:
            if isinstance(token, int):
                opened = self.content[token][0]
                if opened == "`":
                    out = frozenset(("TPL",))
                elif opened == "jsx":
                    out = frozenset(("JSX",))
                else:
                    out = frozenset(w for w in self.grammar.next if w and len(w) > 1 and w[0] == opened and w[-1] in ")]}") | {opened}
            elif token == "id" or token in CONTEXTUAL:
                out = frozenset(("ID", "NAME", token))
            elif token in KEYWORDS:
                out = frozenset(("NAME", token))
            else:
                out = frozenset(({"num": "NUM", "str": "STR", "tpl": "TPL", "re": "RE", "priv": "PRIV"}.get(token, token),))
            self.looks[token] = out
        return out

    def fits(self, token: object, terminal: str) -> bool:
        """Whether a lexeme can stand for a terminal; a group must also parse in its role."""
        if terminal not in self.look(token):
            return False
        if not isinstance(token, int):
            return True
        if terminal not in ("TPL", "JSX"):
            return self.parses(token, terminal[1:-1])
        for p in self.content[token][1]:
            if not (self.parses(p, "Subst") if terminal == "TPL" else self.fits(p, "JSX") if self.content[p][0] == "jsx" else self.parses(p, "Embed")):
                return False
        return True

    def parses(self, number: int, role: str) -> bool:
        key = (number, role)
        out = self.known.get(key)
        if out is None:
            out = True
            for p in pieces(self.content[number][1], role):  # a loop: generators would nest in the interpreter's own stack
                if not self.piece(p, role):
                    out = False
                    break
            self.known[key] = out
        return out

    def piece(self, tokens: tuple, role: str) -> bool:
        key = (tokens, role)
        out = self.known.get(key)
        if out is None:
            out = self.known[key] = self.recognise(tokens, role, self.fits)
        return out

    def recognise(self, tokens: tuple, start: str, fits) -> bool:
        grammar = self.grammar
        following, left, names, nullable = grammar.next, grammar.left, grammar.names, grammar.nullable
        size = len(tokens)
        waiting: list[dict[str, list]] = []
        items = [(s, 0) for s in grammar.begin(start, self.look(tokens[0]) if size else frozenset(("END",)))]
        for i in range(size + 1):
            token = tokens[i] if i < size else None
            look = self.look(token) if i < size else frozenset(("END",))
            seen, here, scanned, tried = set(items), {}, [], {}
            waiting.append(here)
            k = 0
            while k < len(items):
                s, origin = items[k]
                k += 1
                word = following[s]
                if word is None:
                    for w, o in waiting[origin].get(left[s], ()):
                        new = (w + 1, o)
                        if new not in seen:
                            seen.add(new)
                            items.append(new)
                elif word in names:
                    held = here.get(word)
                    if held is None:
                        here[word] = [(s, origin)]
                        for p in grammar.begin(word, look):
                            new = (p, i)
                            if new not in seen:
                                seen.add(new)
                                items.append(new)
                    else:
                        held.append((s, origin))
                    if word in nullable:
                        new = (s + 1, origin)
                        if new not in seen:
                            seen.add(new)
                            items.append(new)
                elif word in look:
                    ok = tried.get(word)
                    if ok is None:
                        ok = tried[word] = fits(token, word)
                    if ok:
                        scanned.append((s + 1, origin))
            if i == size:
                self.stop = i
                return any(following[s] is None and o == 0 and left[s] == start for s, o in items)
            if not scanned:
                self.stop = i
                return False
            items = list(dict.fromkeys(scanned))
        return False

    def cost(self, number: int, role: str, most: int | None = None) -> int:
        """Least number of edits that make a group's content fit a role, at most ``most`` + 1 if that is given."""
        if self.parses(number, role):
            return 0
        key = (number, role, most, "cost")
        out = self.known.get(key)
        if out is None:
            out = 0
            for part in pieces(self.content[number][1], role):
                if not self.piece(part, role):
                    out += self.repair(part, role, None if most is None else most - out)[0]
                    if most is not None and out > most:
                        break
            self.known[key] = out = out if most is None else min(out, most + 1)
        return out

    def weight(self, token: object) -> int:
        """Of how many lexemes a token is: brackets count with all that is in them."""
        if not isinstance(token, int):
            return 1
        key = (token, "weight")
        out = self.known.get(key)
        if out is None:
            out = self.known[key] = 2 + sum(map(self.weight, self.content[token][1]))
        return out

    def scan_cost(self, token: object, terminal: str, most: int | None = None) -> int:
        """Edits within a lexeme that stands for a terminal of its kind: those of a group's content."""
        if not isinstance(token, int) or self.fits(token, terminal):
            return 0
        if most is not None and most < 1:
            return 1  # too many
        if terminal not in ("TPL", "JSX"):
            return self.cost(token, terminal[1:-1], most)
        inner = [(p, "Subst" if terminal == "TPL" else "Embed") for p in self.content[token][1]]
        return sum(self.scan_cost(p, "JSX", most) if self.content[p][0] == "jsx" else self.cost(p, role, most) for p, role in inner)

    def repair(self, tokens: tuple, start: str, most: int | None = None) -> tuple[int, int]:
        """Least number of edits, at most ``most`` + 1 if that is given, and the place of the first; those within inner groups count too.

        Of equally cheap repairs the one counts whose first edit comes last.
        """
        if self.piece(tokens, start):
            return 0, len(tokens)
        if most is not None and most < 1:
            return most + 1, 0
        most = FAR if most is None else most
        if len(tokens) > SHORT:
            cost, first = self.charts(tokens, start, min(most, FEW if len(tokens) <= LONG else FAR))
            if cost <= min(most, FEW) or len(tokens) > LONG or most <= FEW:
                return (cost, first) if cost <= most else (most + 1, 0)
        level = 0
        while len(tokens) > SHORT << level:
            level += 1
        while True:
            self.prepare([tokens], level)
            least, first, highest, other = self.known[tokens, "table"][1][start]
            if least > most:
                return most + 1, 0
            if (least, first) == (highest, other):
                return least, first
            level += 1

    def bounds(self, token: object, terminal: str, level: int) -> tuple[int, int]:
        """Between which numbers of edits a lexeme stands for a terminal of its kind; from some level on, they are equal."""
        if not isinstance(token, int) or self.fits(token, terminal):
            return 0, 0
        todo = [(token, terminal)]
        low = high = 0
        while todo:
            t, x = todo.pop()
            opened, inner = self.content[t]
            if x == "JSX" or x == "TPL":
                todo.extend((p, "JSX" if self.content[p][0] == "jsx" else "Subst" if x == "TPL" else "Embed") for p in inner)
                continue
            role = x[1:-1] if x[0] in "([{" else x
            if self.parses(t, role):
                continue
            for part in pieces(inner, role):
                if not self.piece(part, role):
                    known = self.known.get((part, "table"))
                    if len(part) > LONG < SHORT << level:
                        known = 0, {role: self.charts(part, role, FAR) * 2}
                    least, _, highest, _ = known[1][role] if known else (self.floor(part, role), 0, sum(map(self.weight, part)) + self.grammar.least[role], 0)
                    low += least
                    high += highest
        return low, high

    def floor(self, tokens: tuple, role: str) -> int:
        """No fewer edits than this: those of lexemes that the role never holds."""
        reach = self.grammar.reach(role)
        return max(1, sum(self.weight(t) for t in tokens if reach.isdisjoint(self.look(t))))

    def put_off(self, tokens: tuple, role: str, level: int) -> bool:
        """Whether bounds stand for a piece within another at first: it is long, or has little in common with its role."""
        return len(tokens) > min(LONG, SHORT << level) or not level and len(tokens) > 8 and self.floor(tokens, role) > 5

    def prepare(self, todo: list[tuple], level: int = 0) -> None:
        """Tables of some pieces and of what is faulty within them, many at a time, inner ones first."""
        needs: dict[tuple, list[tuple]] = {}
        order, stack = [], [(t, False) for t in todo if len(t) <= SHORT << level]
        while stack:
            tokens, done = stack.pop()
            if done:
                order.append(tokens)
            elif tokens not in needs:
                known = self.known.get((tokens, "table"))
                if known and (known[0] >= level or all(x[:2] == x[2:] for x in known[1].values())):
                    continue
                needs[tokens] = [p for t in tokens if isinstance(t, int) for p in self.faulty(t, level)]
                stack.append((tokens, True))
                stack.extend((p, False) for p in needs[tokens])
        ranks: dict[tuple, int] = {}
        levels: list[list[tuple]] = []
        for tokens in order:
            rank = ranks[tokens] = max((ranks[p] + 1 for p in needs[tokens] if p in ranks), default=0)
            if rank == len(levels):
                levels.append([])
            levels[rank].append(tokens)
        for own in levels:
            own.sort(key=len)
            while own:
                some, spans = [], 0
                while own and (not some or spans + len(own[-1]) ** 2 // 2 <= SPANS):
                    spans += len(own[-1]) ** 2 // 2 + len(own[-1]) + 1
                    some.append(own.pop())
                self.tables(some, level)

    def faulty(self, token: int, level: int) -> list[tuple]:
        """Pieces of a group that do not parse in a role that its brackets allow."""
        out, todo = {}, [token]
        while todo:
            t = todo.pop()
            opened, inner = self.content[t]
            if opened in ("`", "jsx"):
                for p in inner:
                    if self.content[p][0] == "jsx":
                        todo.append(p)
                    elif not self.parses(p, role := "Subst" if opened == "`" else "Embed"):
                        out.update((x, None) for x in pieces(self.content[p][1], role) if not self.piece(x, role) and not self.put_off(x, role, level))
                continue
            for role in [w[1:-1] for w in self.look(t) if len(w) > 2]:
                if not self.parses(t, role):
                    out.update((x, None) for x in pieces(inner, role) if not self.piece(x, role) and not self.put_off(x, role, level))
        return list(out)

    def tables(self, some: list[tuple], level: int) -> None:
        grammar = self.grammar
        terminals = grammar.repairs.terminals
        kept, weights, looks, two = [], [], [], []
        for tokens in some:
            low, high = [], []
            for t in tokens:
                look, w = self.look(t), self.weight(t)
                both = [self.bounds(t, x, level) if x in look else (max(w, grammar.weight[x]),) * 2 for x in terminals]
                low.append([x for x, _ in both])
                high.append([x for _, x in both])
            two.append(low != high)
            for rows in (low, high)[: 1 + two[-1]]:
                kept.append(np.array(rows, np.int64).reshape(len(tokens), len(terminals)))
                weights.append(np.array([self.weight(t) for t in tokens], np.int64))
                looks.append([self.look(t) for t in tokens])
        found = iter(grammar.repairs.least_edits(kept, weights, looks))
        for tokens, differ in zip(some, two):
            cost, first = next(found)
            most, other = next(found) if differ else (cost, first)
            self.known[tokens, "table"] = level, {r: (int(cost[k]), int(first[k]), int(most[k]), int(other[k])) for r, k in grammar.repairs.column.items() if r in grammar.roles}

    def charts(self, tokens: tuple, start: str, most: int) -> tuple[int, int]:
        """The bound is raised by one as long as there is no parse within it: most faulty pieces need few edits, and
        each more costs as much again. Edits just before the place where the plain parse stops are tried first."""
        key = (tokens, start, "repair")
        found = self.known.get(key)
        if found is not None:
            return found
        self.recognise(tokens, start, self.fits)
        stop, bound = self.stop, 1
        near = max(0, stop - NEAR)
        while bound <= most:
            if self._repair(tokens, start, bound, near) <= bound or near and self._repair(tokens, start, bound, 0) <= bound:
                break
            bound += 1
        else:
            return most + 1, 0
        # the last place before which all can stay as it is: with what begins later there is no such repair
        good, bad, step = 0, stop + 1, NEAR
        while bad - good > 1:
            since = (good + bad) // 2 if good else max(1, bad - step)
            if self._repair(tokens, start, bound, since) <= bound:
                good = since
            else:
                bad, step = since, step * 4
        found = self.known[key] = bound, good
        return found

    def _repair(self, tokens: tuple, start: str, most: int, since: int = 0) -> int:
        """Least number of edits, up to ``most`` + 1, none of them before place ``since``.

        ``spent[i]`` is the least cost of reaching place i at all: what begins there may cost only the rest.
        """
        grammar = self.grammar
        following, left, nullable, least, begun = grammar.next, grammar.left, grammar.nullable, grammar.least, grammar.starts
        size, wide = len(tokens), len(grammar.next)
        looks = [self.look(t) for t in tokens] + [frozenset(("END",))]
        waiting: list[dict[str, list]] = []
        # an item is its origin times ``wide`` plus its state; a column has the cost of each
        columns: list[dict[int, int]] = [{} for _ in range(size + 2)]
        spent = [0] * (size + 1)
        weights = [min(most + 1, self.weight(t)) for t in tokens] + [0]
        fresh = grammar.weight
        for s in grammar.rules[start]:
            columns[0][s] = 0
        for i in range(size + 1):
            column, after, look = columns[i], columns[i + 1], looks[i]
            room = most if i >= since else 0
            if not column:
                break
            spent[i] = min(c + spent[item // wide] for item, c in column.items()) if i else 0
            here: dict[str, list] = {}
            held: dict[str, int] = {}
            waiting.append(here)
            todo: list[list[int]] = [[] for _ in range(most + 1)]
            for item, c in column.items():
                todo[c].append(item)
            lowest = 0
            while lowest <= most:
                if not todo[lowest]:
                    lowest += 1
                    continue
                cost, item = lowest, todo[lowest].pop()
                if column[item] != cost:
                    continue
                o, s = divmod(item, wide)
                left_over = room - spent[o]
                word = following[s]
                if word is None:
                    if o < i:
                        for w, wo, wc in waiting[o].get(left[s], ()):
                            new, total = wo * wide + w + 1, wc + cost
                            if total <= most and total + spent[wo] <= most:
                                old = column.get(new)
                                if old is None or total < old:
                                    column[new] = total
                                    todo[total].append(new)
                    continue
                stays = o == i and s in begun and not (i == 0 and left[s] == start)  # what is predicted here is predicted behind the next lexeme too
                if word in least:
                    if word not in here:
                        here[word] = []
                        barred = word in NOT_AT and not NOT_AT[word].isdisjoint(look)
                        if not barred or spent[i] < room:
                            new_cost = 1 if barred else 0  # as if an operator were put in before
                            for p in grammar.rules[word] if spent[i] < room else grammar.begin(word, look):
                                new = i * wide + p
                                if new not in column:
                                    column[new] = new_cost
                                    todo[new_cost].append(new)
                            lowest = min(lowest, new_cost)  # what is predicted costs less than what asks for it
                    here[word].append((s, o, cost))
                    total = cost if word in nullable else cost + least[word]
                    if total <= (most if total == cost else left_over) and total <= most:
                        old = column.get(item + 1)
                        if old is None or total < old:
                            column[item + 1] = total
                            todo[total].append(item + 1)
                    total = cost + weights[i]
                    if total <= left_over and i < size and not stays:
                        # without this lexeme
                        old = after.get(item)
                        if old is None or total < old:
                            after[item] = total
                    continue
                if i < size and word in look:
                    inside = held.get(word)
                    if inside is None:
                        inside = held[word] = self.scan_cost(tokens[i], word, left_over - cost)  # the cheapest come first
                    total = cost + inside
                    if total <= most and total + spent[o] <= (room if inside else most):
                        old = after.get(item + 1)
                        if old is None or total < old:
                            after[item + 1] = total
                if cost < left_over:
                    total = cost + max(weights[i], fresh[word])
                    if i < size and total <= left_over and word not in look and ((old := after.get(item + 1)) is None or total < old):
                        after[item + 1] = total
                    total = cost + weights[i]
                    if i < size and total <= left_over and not stays and ((old := after.get(item)) is None or total < old):
                        after[item] = total
                    total = cost + fresh[word]
                    if total <= left_over and ((old := column.get(item + 1)) is None or total < old):
                        column[item + 1] = total
                        todo[total].append(item + 1)
        return min((c for item, c in columns[size].items() if item < wide and following[item] is None and left[item] == start), default=most + 1)


def cuts(tokens: tuple) -> list[list[range]]:
    """Where the parts between semicolons lie; what begins with else goes on with the part before."""
    out: list[list[range]] = []
    at = 0
    for i, t in enumerate([*tokens, ";"]):
        if t != ";":
            continue
        own = range(at + (at < i and tokens[at] == "NL"), i)
        first = tokens[own.start] if len(own) else None
        joined = [tokens[k] for r in out[-1] for k in r] if out and first in ("else", "while") else []
        if out and first == "else" or joined and first == "while" and joined[0] == "do" and "while" not in joined:
            out[-1].append(own)
        else:
            out.append([own])
        at = i + 1
    return out


def pieces(tokens: tuple, role: str) -> list[tuple]:
    """A group's content, for some roles cut at its semicolons."""
    if role not in SPLIT or ";" not in tokens:
        return [tokens]
    return [tokens[own[0].start : own[0].stop] if len(own) == 1 else tuple(tokens[k] for r in own for k in r) for own in cuts(tokens)]
