"""The weighted lexicon of `abuse`: words by category and language, and phrases built from slots.

An entry has a kind and a weight.  Entries of the kind `self` stand for themselves; the others
count in the company that `RULES` names.  `{a, b}` in a phrase stands for one of several words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

#: The lexicon, by kind and weight; one line a theme, entries separated by `|`.
ENTRIES: dict[tuple[str, float], str] = {
    ("self", 2.0): """
asshole|arsehole|motherfucker|cunt|whore|slut|dipshit|faggot|nigger|nigga|bitch|wanker|dickhead|scumbag|dumbass|shithead|douchebag|fuckwit|fucktard|bellend|tosser|kike|wetback|raghead|tranny|cocksucker|fuckface|shitstain|skank
{fuck, screw, piss, sod, bugger} {off, you, yourself, your mother}|go {to hell, die, fuck yourself, hang yourself, kill yourself, drown yourself, play in traffic}|{burn, rot} in hell|eat shit|drop dead|shut up|shut your {mouth, face, trap}|shut the fuck up|get stuffed|kiss my ass|crawl back {under, into}
piece of shit|{kill, hang, drown} yourself|kys|waste of {air, oxygen, skin}|worth the {air, oxygen, skin}|excuse {for, of} a {human, man, woman, person, developer, programmer, coder, engineer, mother, father, reviewer}
as {dumb, stupid, thick, dense, ugly, useless, worthless, dim} as you|nobody {asked for your, wants you, likes you, needs you, loves you, cares about you, would miss you, will miss you}|no one {asked for your, wants you, likes you, needs you, loves you, would miss you, will miss you}
{should, shouldnt, should not, should never, ought never} {be, to be} let near a {keyboard, computer, terminal, repository}|{spare, save} us your|{ugly, stupid, fat, smug} face of yours|you {stink, reek, suck}
""",
    ("self", 3.0): """
{know, found, find, find out, found out, figure out} where you {live, sleep}|watch your back|you are dead meat|youre dead meat|wont live to see|{burn, blow} {down your house, up your house, your house down}|come after {you, your family, your kids}
{deserve, deserves, deserved} to {rot, die, suffer, burn, hang}|hope you {rot, die, choke, suffer, burn, drown, bleed, crash and burn}|hope you {lose your job, get cancer, get fired, get run over, get hit, never wake up}|hope your {family, kids, mother} {dies, die, burns, burn, suffers, suffer}
choke on your own|{kick, punch, slap, boot, fist, bullet, knife} {in, to, into} {the, your} {teeth, face, head, balls, nuts, groin, skull}|favour and {die, vanish, jump, do it}|favor and {die, vanish, jump, do it}|{world, everyone, project} would be better off without you
wish you {were dead, were never born, had never been born}|never have been born|should have been aborted
heil hitler|white power|master race|gas the {jews, muslims, blacks, gays, lot}|go back to your {country, village, own country}|{people, men, women} of their kind|go back where you came from
""",
    ("self", 1.5): """
{lick, grab, touch, squeeze, spank, fondle, grope, caress, rub, suck, kiss, stroke, bite, pinch} {your, her, his, my, those} {ass, arse, body, tits, breasts, boobs, cock, dick, pussy, thighs, butt, nipples, lips, legs, neck, chest}
sex with {you, me, her, him, girls, women, boys}|sex {chat, video, videos, tape, cam, show, slave}|nudes|{nude, naked} {pics, photos, pictures, selfie, selfies, girls, women, boys, teens, men}|{see, want, get, imagine} {you, her, him} {naked, nude, undressed, in bed, wet}
{make, making, made} {you, her, him, me} {moan, scream, come, cum, beg, wet}|ride {you, me, my cock, your cock}|horny|{touch, touching, touched} myself|{jerk, jack, jerking, jacking} off to|{took, take, takes, taking, rip, slip} off {her, his, your, my, their} {panties, pants, bra, clothes, underwear, shirt, dress, skirt}
begged me to {come, fuck, take}|come inside {me, her, you}|bend over {and, baby, for me, the desk, my desk}|strip and {moan, dance}|strip for {me, us}|hardcore {clips, porn, video, videos, action, sex}|porn|porno|pornhub|xxx {video, videos, clips, pics}
blowjob|handjob|cumshot|gangbang|milf|creampie|deepthroat|{nice, nicer, great, big} {tits, boobs}|in my bed|to my {bed, bedroom}|undress for|{want, love, like} to fuck|fuck {her, him, me, them} {on, in, over, behind, hard, all night}|my {cock, dick, pussy}|your {cock, tits, pussy, nipples}|suck my|wet for {me, you}|sleep with me
""",
    ("noun", 1.0): """
idiot|moron|imbecile|cretin|clown|buffoon|halfwit|loser|bastard|coward|fool|jerk|pig|scum|parasite|dimwit|nitwit|twit|dummy|retard|swine|weasel|lowlife|filth|trash|dunce|dolt|simpleton|nincompoop|numbskull|blockhead|bonehead|airhead|pinhead|meathead|oaf|cockroach|maggot|rat|vermin|leech|creep|pervert|subhuman|troglodyte|mongrel|twat|fag|spic
failure of a {human, man, person, developer}|waste of {space, breath, time and skin}|pile of {shit, crap, garbage, filth}|{pea, bird, half, monkey} {brain, wit}|make me sick|makes me sick|disgrace to {humanity, the team, this project}|sack of {shit, crap}
idiota|imbecil|trottel|depp|idioten|cretino|debil|vollidiot|scemo|burro
""",
    ("adjective", 0.7): """
brainless|spineless|pathetic|worthless|disgusting|miserable|useless|rotten|stupid|dumb|ugly|clueless|incompetent|shitty|braindead|witless|moronic|idiotic|mindless|gutless|illiterate|retarded|repulsive|vile
""",
    ("contempt", 1.5): """
want to {spit, puke, vomit, throw up, shit}|{stink, stinks, stinking} up {this, the, our}|joke nobody {laughs, laughed} at|{is, are} why {people, men, everybody} {get, gets} fired|grade {brain, brains}|{brain, brains} from a {bin, skip, dumpster, cereal box, toilet}|brains are too small|{stink, reek} of
""",
    ("beats", 1.5): "{better, smarter, faster, cleverer, brighter} than you|smarter too",
    ("creature", 0.0): "dog|cat|goldfish|hamster|parrot|monkey|chimp|toddler|grandma|grandmother|brick|potato|rock",
    ("violent", 3.0): "kill|murder|hurt|beat|smash|stab|shoot|strangle|choke|punch|slap|hang|burn|drown|bury|skin|whip|lynch|rape|slaughter|butcher|crush|break|hunt|gas|cripple|gut",
    ("body", 0.0): "you|yourself|your {face, neck, fingers, legs, arms, kneecaps, skull, teeth, jaw, throat, bones, nose, head, family, mother, kids, children, wife, husband, house}|every bone",
    ("intent", 0.0): "i|ill|im|we|someone|somebody|let me|lets|id",
    ("negation", 0.0): "not|dont|doesnt|wont|never|didnt|cant|wouldnt|without",
    ("wish", 0.0): "deserve|deserves|ought|should|need|needs|must|want to see",
    ("punished", 2.5): """
beaten|shot|hanged|stabbed|whipped|lynched|gassed|raped|strangled|castrated|sterilized|exterminated|punched|flogged|slapped|{dumped, thrown, left, tossed, buried} in {a, the} {ditch, gutter, sewer, swamp, landfill, grave, river}|put down like
""",
    ("target", 0.0): """
you|your|yours|youre|yourself|u|author|authors|maintainers|maintainer|whoever|reviewer|reviewers|team|lot|du|dich|dein|deine|eres|tu|te|ihr|sie|sei|voce|ты|вы|тебя|такой
""",
    ("group", 0.0): """
women|woman|females|immigrant|immigrants|gays|lesbians|refugees|foreigners|southerners|northerners|easterners|westerners|villagers|muslims|jews|christians|hindus|catholics|blacks|asians|mexicans|indians|africans|arabs|gypsies|roma|homosexuals|girls|migrants|natives|peasants|infidels
{gay, black, brown, asian, jewish, muslim, arab, african, mexican, indian, disabled, autistic, trans, transgender, queer, old, poor, fat, foreign, religious, romani, deaf, blind} {people, folks, men, women, guys, kids}
{those, these, that, your, their, her, his} {people, sort, kind, lot}|people {of, from} {that, this, their} {faith, kind, religion, race, country, caste, region, village}|poles|turks|russians|albanians|nigerians
auslander|etrangers|extranjeros|inmigrantes|fluchtlinge|juden|turken|behinderte|frauen|immigres|femmes|arabes|juifs|noirs|mujeres|moros|gitanos|stranieri|immigrati|негры|чурки|евреи|мигранты
""",
    ("degrading", 2.5): """
rats|vermin|plague|disease|animals|subhuman|subhumans|filth|liars|pigs|parasites|cockroaches|savages|leeches|scum|maggots|apes|insects|{breed, breeding, multiply} like|born {liars, thieves, losers, criminals}|too {stupid, dumb, lazy, primitive} to
{kept, driven, thrown, keep, drive, throw} {out, them out}|locked up|{sent, send} back|send them {back, home}|back where they came from|back to where they came|no place {among, in, here}|same rights as|{must, should} never be|never be {hired, trusted, allowed}|not {human, humans}
should be {banned, deported, exterminated, sterilized, wiped out, eliminated, segregated}|wiped out|wipe out|{exterminate, eradicate, deport}|get rid of|{ban, deport, expel, fire} {all, every}|{ruin, ruins, ruining} {every, everything, our}|{belong, belongs} in {a, the} {kitchen, cage, zoo, camp, jungle, gutter, asylum}
cant {write code, code, think, be trusted, drive}|lazy|thieving|by {blood, nature, birth}|hire fewer|never hire|stop hiring|why do we let|bring {dirt, disease, crime, filth}|dirty|inferior|brains are too small|better {without, off without}|dont {deserve, belong}|infest|infesting|invading|hate all
ungeziefer|ratten|raus|pack|parasiten|vergasen|vermine|dehors|rats|parasites|ratas|basura|fuera|que se vayan|a la cocina|ratti|fuori|вон|твари
""",
    # German, Spanish, French, Italian, Portuguese, Dutch, Polish, Turkish, Russian
    ("self", 1.8): """
verpiss dich|arschloch|hurensohn|halt {die fresse, die klappe, dein maul, deine fresse}|fick dich|missgeburt|wichser|drecksau|schlampe|fotze|spast|geh sterben|{dummes, wertloses, elendes} {stuck, stuck dreck, schwein}|stuck {dreck, scheisse}|ich bring dich um|ich bringe dich um|verrecke|scheiss auslander
vete a la mierda|cabron|hijo de puta|hija de puta|{eres, sois} {una basura, basura, una mierda, un inutil, un inutil de mierda}|nadie te quiere|cierra {la boca, el pico}|gilipollas|imbecil inutil|puta madre|que te jodan|muerete|te voy a matar|zorra|maricon|pendejo|subnormal
ferme ta gueule|ta gueule|pauvre {cretin, con, type, conne, tache}|va te faire|connard|connasse|encule|salope|fils de pute|tu es un dechet|tu n es qu un dechet|creve|je vais te tuer|sale {con, arabe, juif, noir, pute}|nique ta mere|espece d idiot
vaffanculo|pezzo di merda|stronzo|figlio di puttana|coglione|testa di cazzo|troia|vai se foder|filho da puta|vai tomar no cu|seu merda|klootzak|kankerlijer|spierdalaj|pierdol sie|orospu cocugu|siktir
пошел на хуй|пошла на хуй|иди на хуй|сука блядь|мудак|ублюдок|ты {идиот, дебил, тупой, урод, тварь, дура}|сдохни|убью тебя|пидор|шлюха
""",
    # without blanks between words: Chinese, Japanese, Korean
    ("self", 1.6): """
傻逼|他妈的|操你|去死|蠢货|贱人|婊子|脑残|杂种|狗娘养|王八蛋|混蛋|你是垃圾|你这个垃圾|没用的东西|滚出去|强奸你|想上你|发裸照|约炮|肏|白痴东西
死ね|くたばれ|消え失せろ|バカ野郎|馬鹿野郎|クソ野郎|ゴミ野郎|お前はゴミ|殺すぞ|殺してやる|役立たずめ|能無しめ|やらせろ|裸の写真を送|シバル|씨발|개새끼|병신|꺼져
""",
    #: In the sentence of these nothing counts: talk about rules, reports and tests, medicine and security, and talk about oneself.
    ("exception", 0.0): """
code of conduct|{get, gets, are, is} blocked|{words, terms, phrases, strings} {such as, like}|moderation {test, tests, rule, rules}|was reported|comment removed|word {list, filter}|profanity filter|{flagged, marked} as|called someone|forbids insults|slurs such as|bad words|test checks
sexual {health, education, orientation}|breast cancer|{penetration, pen} {test, tests, tester, testing}|{are, is} welcome
like me|as the one who|of me|mine of course|my own|my bad|my fault|i am {such, so, a, an, the}|im {such, so, a, an, the}|i was {such, so, a, an, the}|i felt|me included|sorry everyone
审核|过滤|敏感词|屏蔽|禁止使用|テストです|禁止語|禁止用語
""",
}

#: Nouns have plurals, adjectives superlatives; verbs of violence keep their plain form.
PLURAL = ("noun",)

#: What counts in which company: (kind, [(other kind, words before, words after, wanted)], own weight).
#: A place counts where every wanted kind begins within the words before and after it, and no unwanted one does.
RULES: list[tuple[str, list[tuple[str, int, int, bool]]]] = [
    ("self", []),
    ("noun", [("target", 6, 6, True)]),
    ("adjective", [("near target", 2, 4, True)]),
    ("contempt", [("target", 14, 6, True)]),
    ("contempt", [("noun", 14, 6, True)]),
    ("beats", [("creature", 12, 0, True)]),
    ("violent", [("body", 0, 3, True), ("intent", 8, 0, True), ("negation", 4, 0, False)]),
    ("violent", [("group", 0, 4, True), ("intent", 8, 0, True), ("negation", 4, 0, False)]),
    ("punished", [("wish", 5, 0, True), ("target", 14, 6, True)]),
    ("punished", [("wish", 5, 0, True), ("noun", 14, 6, True)]),
    ("punished", [("wish", 5, 0, True), ("group", 14, 6, True)]),
    ("degrading", [("group", 14, 14, True)]),
]
#: Of the targets, those that adjectives do not count against: what follows them is as often a thing.
LOOSE_TARGETS = frozenset("your team tu sie lot te".split())

_SLOT = re.compile(r"\{([^}]*)\}")


def expanded(phrase: str) -> Iterator[str]:
    """All phrases that a phrase with slots stands for."""
    parts = _SLOT.split(phrase)
    slots = [[p] if k % 2 == 0 else [x.strip() for x in p.split(",")] for k, p in enumerate(parts)]
    for words in product(*slots):
        yield " ".join("".join(words).split())


def phrases() -> Iterator[tuple[str, float, str]]:
    """(kind, weight, phrase) of the whole lexicon."""
    for (kind, weight), text in ENTRIES.items():
        for entry in text.replace("\n", "|").split("|"):
            if entry.strip():
                for p in expanded(entry.strip()):
                    yield kind, weight, p
                    if kind in PLURAL and " " not in p and not p.endswith("s"):
                        yield kind, weight, p + ("es" if p.endswith(("ch", "sh", "x")) else "s")
                    if kind == "adjective":
                        yield kind, weight, (p[:-1] + "i" if p.endswith("y") else p.removesuffix("e")) + "est"
