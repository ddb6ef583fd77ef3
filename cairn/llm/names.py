"""Names for training: fixed lists of common ones, and sentences made of them by rule."""

from __future__ import annotations

import random
import re

# Common given names that are no common words, by language.
GIVEN = """
James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Daniel Karen Matthew Nancy Anthony Lisa Steven Emily Andrew Emma Kevin Laura Brian Rachel George Olivia Edward Hannah Lucas Sophie Oliver Charlotte Henry Amelia
Anna Lena Julia Katharina Sabine Monika Stefan Jürgen Wolfgang Klaus Andreas Matthias Tobias Florian Sebastian Johannes Lukas Felix Heike Ursula Ingrid Birgit Petra Claudia
Marie Camille Chloé Léa Manon Julien Nicolas Pierre Jean Michel Philippe François Laurent Sylvie Isabelle Nathalie Céline Aurélie Mathieu Antoine Hélène Élodie
María Carmen Ana Isabel Lucía Paula Marta Elena Antonio José Manuel Francisco Javier Carlos Miguel Alejandro Pablo Sergio Fernando Diego Álvaro Rosa Pilar Teresa
""".split()
# Common family names of the same languages.
FAMILY = """
Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Thompson Walker Connor Harris Clark
Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Hoffmann Schäfer Koch Bauer Richter Klein Wolf
Martin Bernard Dubois Durand Moreau Lefebvre Leroy Roux Fournier Girard Lambert Fontaine Rousseau
García Rodríguez González Fernández López Martínez Sánchez Pérez Gómez Ruiz Hernández Díaz Moreno
""".split()
# Characters that given names are often written with: those that other words seldom have, and others.
HAN_GIVEN = "伟芳娜秀英敏丽磊洋艳杰娟霞刚桂鹏浩欣怡婷雪梅琳俊凯佳慧颖莉斌"
HAN_OTHER = "明平建国文力强红华志海玉静超健辉小军勇涛兰飞宇峰晨波燕玲"

# Sentences that names stand in, and words that are none; {n} a name, {x} something else that is written alike.
FRAMES = """
My name is {n} and I agree. | {n} called this morning. | I spoke with {n} about it. | Please ask {n} to reply soon. | {n} and {n} will join us. | Thanks, {n}! | Hi {n}, how are you? | We hired {n} last year. | According to {n}, it works now. | {n} wrote the summary. | The note from {n} arrived. | {n}'s report is late. | Mr. {n} is away. | Best regards, {n} | Then {n} left early. | When {n} asked, nobody knew. | It was {n} who found it. | Last week {n} helped us. | {n} sent {n} a long letter.
Ich heiße {n} und komme gern. | Ich habe mit {n} gesprochen. | {n} kommt morgen. | Bitte fragen Sie {n}. | Laut {n} stimmt das. | Grüße von {n} | {n} und {n} arbeiten daran. | Herr {n} ist krank. | Heute war {n} im Büro. | Danach hat {n} alles erklärt.
Je m'appelle {n}, enchanté. | J'ai parlé avec {n}. | {n} arrive demain. | Selon {n}, c'est bon. | Merci {n} ! | {n} et {n} travaillent ici. | Madame {n} est absente. | Ensuite {n} a tout relu.
Me llamo {n}, mucho gusto. | Hablé con {n} ayer. | {n} llega mañana. | Según {n}, funciona. | Gracias, {n} | {n} y {n} trabajan aquí. | La señora {n} no está. | Luego {n} lo revisó todo.
The {x} team meets today. | We moved to {x} 2.1 yesterday. | Open {x} and press start. | In {x} it often rains. | {x} crashed again. | Version 3 of {x} is out. | Die {x} Gruppe tagt heute. | Das neue {x} läuft. | L'équipe {x} se réunit. | Le projet {x} avance. | El equipo {x} se reúne. | La versión de {x} salió. | Monday and Friday suit us. | The English and French texts differ. | Der Bericht zur Sitzung liegt vor. | Die Aufgabe ist im Plan. | On {x} we saw the error. | From {x} to {x} it takes long.
""".replace("\n", " | ").split(" | ")
HAN_FRAMES = """
我叫{n}，请多关照。 | 联系人：{n}。 | {n}说明天再来。 | 我和{n}一起去。 | 请问{n}在吗？ | {n}的报告写好了。 | 昨晚{n}打来电话。 | {n}先生不在。 | 感谢{n}的帮助。 | {n}和{n}都去了。 | 这件事由{n}处理。 | {n}，你好。 | 请告诉{n}。 | {n}已经走了。 | 听{n}讲过。 | 大家都等{n}。
马上开始方法测试。 | 高山和江河都在地图上。 | 白色的金石很贵。 | 黄色的田野常常很安静。 | 万一失败，任何人都可以重试。 | 余下的时间用于严格检查。 | 向前走，再向左转。 | 叶子落在石头路上。 | 许多程序需要武器以外的工具。 | 方便的话，段落可以再短一点。 | 东方的天空很亮。 | 第五章在南门附近。 | 于是我们安排了新的计划。 | 周末的时候，钱不是问题。 | 常用的任务由系统处理。 | 范围和程度都要说明。
""".replace("\n", " | ").split(" | ")


def _invented(r: random.Random) -> str:
    return "".join(r.choice("b br c d dr f g gr h k kl l m n p r s st t v w z".split()) + r.choice("a e i o u ai ei".split()) for _ in range(r.randrange(1, 4))).capitalize() + r.choice("n r s x l ck rt".split())


def _name(r: random.Random) -> str:
    given, family = r.choice(GIVEN), r.choice(FAMILY) if r.random() < 0.5 else _invented(r)
    return given if r.random() < 0.4 else f"{given} {family}"


def _han_name(r: random.Random, surnames: str, compound: list[str]) -> str:
    given = lambda: r.choice(HAN_GIVEN + HAN_OTHER) if r.random() < 0.85 else chr(r.randrange(0x4E00, 0x9FA0))
    return (r.choice(compound) if r.random() < 0.2 else r.choice(surnames)) + "".join(given() for _ in range(r.choice((1, 2, 2))))


def sentences(surnames: str, compound: list[str], rows: int = 5000, seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts made of the frames by rule, each with the places of its names."""
    r = random.Random(seed)
    plain, han = ([f.strip() for f in fs if f.strip()] for fs in (FRAMES, HAN_FRAMES))
    out = []
    for _ in range(rows):
        text, places = "", []
        chinese = r.random() < 0.4
        for frame in r.sample(han if chinese else plain, 2):
            for piece in re.split(r"(\{[nx]\})", frame):
                if piece == "{n}":
                    name = _han_name(r, surnames, compound) if chinese else _name(r)
                    places.append((len(text), len(text) + len(name)))
                    text += name
                else:
                    text += _invented(r) if piece == "{x}" else piece
            text += "" if chinese else " "
        out.append((text, places))
    return out
