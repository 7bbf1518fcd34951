"""Sentences written after the lexicon was fixed; it was not changed for them."""

from cardmill.llm import abuse as A

ABUSIVE = [
    "I will stab you in your sleep tonight.", "All Martians are animals and should be shot.", "The word is that you are a moron, kill yourself.", "Historians like you are worthless idiots.", "We will find you and break your legs.",
    "You are nothing but a lazy pig.", "Someone should punch her in the face.", "Go back where you came from, you filthy cockroach.", "Those people are rats and must be wiped out.", "Immigrants are a disease and should all be deported.",
    "Your mother is a whore.", "What a dumb bitch she is.", "Get out of here before I beat you bloody.", "They had sex on the kitchen table while he moaned.", "Click for nude pics and hardcore porn.",
    "She unbuttoned her dress and kissed his naked body.", "He could not stop masturbating to the video.", "Nobody likes you, you ugly freak.", "Hope you get cancer, loser.", "Die, you piece of garbage.",
    "These foreigners breed like rabbits and steal our jobs, kill them all.", "You're a disgusting little worm.", "I swear I will burn your house down.", "Women are too stupid to vote.", "Shut up, you pathetic clown.",
    "Du bist ein wertloser Idiot.", "Ich bringe dich um, du Schwein.", "Diese Leute sind Ungeziefer, weg mit den Ratten.", "Verpiss dich, du Missgeburt.", "Tu es un crétin et personne ne t'aime.",
    "Ferme ta gueule, sale porc.", "Ces gens sont de la vermine, à mort les traîtres.", "Eres un imbécil y un cobarde.", "Te voy a matar, cerdo.", "Esa gente es escoria, hay que matarlos a todos.",
    "Y0u are a w0rthl3ss p1g.", "y o u are an i d i o t", "Fυck off, you mоrоn.", "You st*pid m***n, drop d*ad.", "Suck my dick, teacher.",
]
PLAIN = [
    "The pig was domesticated about nine thousand years ago.", "Rats are used to study memory.", "Parasites such as fleas live on their hosts.", "The general ordered that the bridge should be burned.", "You are free to copy these notes.",
    "If you divide both sides by two, you will find the answer.", "The word idiot once meant a private citizen.", "The court heard that he had threatened to kill her.", "In the novel the captain calls his mate a coward.", "The slur moron was common in the press of the time.",
    "Sex is determined by the chromosomes of the father.", "Breast cancer is more frequent after fifty.", "The nude in Western painting goes back to antiquity.", "The statue shows a naked youth holding a spear.", "Vaccines were tested on monkeys and dogs.",
    "Kill the server before you restart it.", "The virus will kill the cell within hours.", "Cockroaches are insects of the order Blattodea.", "Worms are hermaphrodites, so all are able to lay eggs.", "The trash is sorted into paper, glass and metal.",
    "The regime declared that Jews were to be deported.", "Propaganda compared minorities to vermin, which prepared the crime.", "She was sick of the dirt in the hospital.", "Hot wet summers favour the fungus.", "The clown fish lives in anemones.",
    "Who wrote the Odyssey is unknown.", "People who smoke have a higher risk.", "All of them were burned in the fire of 1666.", "Snakes shed their skin several times a year.", "You will regret nothing if you revise early.",
    "Der Idiot ist ein Roman von Dostojewski.", "Ratten übertragen Krankheiten.", "Die Kinder gehören zur dritten Gruppe.", "Le porc est élevé en Bretagne.", "La chatte a eu quatre petits.",
    "Les parasites affaiblissent la plante.", "La basura se recoge los lunes.", "La rata es un animal de laboratorio.", "El sexo se determina en la fecundación.", "The beating of the heart slows in sleep.",
]


def test_held_out_sentences():
    own = A.Scorer()

    def flagged(texts):
        return [t for t in texts if any(score >= A.THRESHOLD for score, _, _ in own.sentences(t))]

    assert len(flagged(ABUSIVE)) == 39
    assert flagged(PLAIN) == ["Cockroaches are insects of the order Blattodea.", "You will regret nothing if you revise early.", "La chatte a eu quatre petits."]
