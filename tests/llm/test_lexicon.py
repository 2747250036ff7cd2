"""The lexicon on sentences that were written apart from the test tables and from the lexicon."""

import time

from gnomon.llm import abuse, lexicon

ABUSIVE = [
    # insults
    "What kind of dunce wrote this, you?", "Your code is garbage because you are a complete moron.", "You absolute numbskull, did you even run it?", "Only an oaf like you would push to main on a Friday.", "You're nothing but a pathetic waste of oxygen.",
    "The reviewer is a clueless twit.", "Are you really this stupid or just pretending?", "Screw you and your mother.", "Piss off, nobody wants you here.", "You incompetent clown, go back to school.", "Kiss my ass, I am not fixing this.", "This maintainer is a spineless weasel.",
    "You are the dumbest person I have ever met.", "My goldfish reviews pull requests better than you.", "you stupid b*tch", "y o u  a r e  a  m o r o n", "U R an 1d10t", "What an ugly, worthless pig you are.", "Eat sh!t and die.", "You make me sick, you rotten scumbag.",
    # threats
    "I hope your family burns.", "I will find you and I will kill you.", "Somebody should strangle you with a network cable.", "I know where you live.", "You deserve to die in a fire.", "If we meet I'll smash your face.", "Whoever wrote this ought to be shot.", "Keep it up and I will break your legs.", "You should go hang yourself.",
    "I'm going to beat you until you cannot type.", "A bullet to the head is what you need.", "Do the world a favor and die.", "You had better watch your back.", "I hope you choke on it.",
    # hate
    "Women are too stupid to write compilers.", "All immigrants are subhuman.", "Exterminate all of those people.", "Jews are vermin.", "Why do we let foreigners touch the build?", "Deport every one of these Muslims.", "Gay people are a disease.", "Black people should never be trusted with root.", "Those refugees breed like cockroaches.",
    "Their kind belongs in a zoo.", "The team would be better off without women.", "Hire no Mexicans, they are lazy liars.", "Kill all infidels.", "Go back to your country.",
    # sexual
    "Sleep with me and I'll merge it.", "Send nudes first.", "I want to lick your neck.", "She let him squeeze her tits.", "Free porn at https://x.example", "I would love to see you naked on that chair.", "He took off her dress and fucked her hard.", "Come to my hotel room and suck my cock.", "Show me your boobs, sweetheart.", "I get so wet for you.",
    # other languages
    "Du bist so ein Vollidiot.", "Halt dein Maul, du Schlampe.", "Ausländer sind Parasiten.", "Eres un imbécil, vete a la mierda.", "Te voy a matar.", "Sois unas zorras.", "Nique ta mère, sale con.", "Les étrangers sont des rats.", "Ta gueule, connasse.", "Sei uno stronzo.", "Vai tomar no cu, seu merda.", "Ты дебил, иди на хуй.", "Сдохни, тварь.",
    "你这个废物，去死吧。", "傻​逼", "滚出去，贱人", "お前はゴミだ。死ね。", "殺すぞ", "Ungeziefer, diese Flüchtlinge, alle raus.",
]
CLEAN = [
    "Kill the worker if it does not answer.", "The parent process should kill its children.", "This will break your build if you do not pin it.", "We should hang the query off the index.", "The branch was burned into the firmware.", "That is a stupid bug.", "This dumb regex matches everything.", "The code is ugly but it works.", "Shoot me a message when you are done.",
    "I will beat the benchmark next week.", "The job should be shot down by the scheduler.", "Dirty pages are written back.", "An orphaned child is adopted by init.", "The parser chokes on your input.", "I hope you get well soon.", "You should see the naked pointer in that struct.", "The strip option removes symbols.", "Women in the survey answered more often.",
    "Refugees are counted by the ministry each year.", "Old people use larger fonts, so test zoom.", "Blind people cannot use this dialog.", "The rat dataset has 40 animals.", "The plague table lists cases by year.", "Jews and Muslims celebrate different holidays in the calendar package.", "Breast cancer rates are in column five.", "Gender and sex are separate columns.",
    "Sexual orientation must not be logged.", "The filter removes words such as idiot and whore.", "I am an idiot, I forgot to push.", "Sorry, stupid of me, you were right.", "We forbid insults like moron in our code of conduct.", "You can touch the file to force a rebuild.", "Do not grab the lock twice.", "Ride out the spike with a queue.", "He was fired from a cannon in the game demo.",
    "Please be nice to the reviewers.", "Your patch is great, thank you.", "The team did a lovely job.", "You may want to throw an error here.", "The test fails for foreigners' names with accents.", "Dump it in the trash folder.", "The garbage collector is lazy.", "Diese Klasse ist raus aus dem Paket.", "Die Ratten im Labor sind gezählt.", "El paquete va fuera del repositorio.", "Le rat de laboratoire est dans la table.",
    "Master and slave replicas are renamed.", "The blacklist became a blocklist.", "A penetration test found nothing.", "Monkey patching is discouraged.", "It hurts performance.", "This hack sucks.", "What the hell is this flag?", "Damn, it is broken again.", "垃圾回收器很慢。", "死锁检测", "必ず死ぬプロセスを監視する。", "杀死进程后重启。",
]


def test_recall_and_precision_on_sentences_of_our_own():
    lex = abuse.Lexicon()
    missed = [t for t in ABUSIVE if not lex.events(t)[1]]
    wrong = [t for t in CLEAN if lex.events(t)[1]]
    print(f"recall {1 - len(missed) / len(ABUSIVE):.3f}, clean {1 - len(wrong) / len(CLEAN):.3f}", missed, wrong)
    assert len(missed) <= 0.15 * len(ABUSIVE) and len(wrong) <= 0.03 * len(CLEAN)


def test_scripts_without_blanks_are_folded_and_excepted():
    lex = abuse.Lexicon()
    for text in ("傻逼", "傻​逼", "傻 逼", "傻.逼", "你好。傻逼！", "死ね。", "お前 死ね"):
        assert lex.events(text)[1], text
    for text in ("moderation test 傻逼", "敏感词：傻逼", "过滤 傻逼 这类词"):
        assert not lex.events(text)[1], text
    assert lex.events("过滤完成。你这个傻逼")[1]


def test_masked_words_take_linear_time():
    def took(n):
        lex = abuse.Lexicon()
        text = "you c****d and b*****d and s**t " * (n // 3)
        t = time.perf_counter()
        lex.events(text)
        return time.perf_counter() - t

    took(30)
    small, large = took(1500), took(12_000)
    assert large < 20 * small + 0.5 and large < 20


def test_scores_are_weights_per_hundred_words():
    lex = abuse.Lexicon()
    weight, events, n = lex.events("you idiot")
    assert (events, n) == (1, 2) and weight == 1.0
    assert all(kind in {k for k, _ in lexicon.ENTRIES} | {"near target"} for kind, company in lexicon.RULES for kind in (kind, *(c[0] for c in company)))
