"""Answers in many languages that were written down before the rules were tried on them, and
that no rule may be fitted to: how many defects are found, and how many findings are right."""

from __future__ import annotations

from millrace.llm.pairs import defects

KO = "정전이 되면 승강기에 갇힌 사람은 무엇을 해야 하는가?"
EN = "What should people trapped in a lift do when the power fails?"
DE = "Was sollen Menschen tun, die bei einem Stromausfall im Aufzug eingeschlossen sind?"
FR = "Que doivent faire les personnes bloquées dans un ascenseur pendant une panne de courant ?"

HELD_OUT = [
    # Refusals in the language of the question.
    (KO, "그 부분은 제가 말씀드리기 곤란합니다.", "refusal"), (KO, "죄송하지만 도움을 드릴 수가 없네요.", "refusal"), (KO, "주어진 자료로는 알 수가 없습니다.", "refusal"),
    (EN, "I am afraid I am unable to help you here.", "refusal"), (EN, "There is not enough information to answer this.", "refusal"), (EN, "I must decline to comment on that.", "refusal"),
    (EN, "This goes beyond my abilities, sorry.", "refusal"), (EN, "No comment.", "refusal"), (DE, "Dazu kann ich leider keine Auskunft geben.", "refusal"), (DE, "Das weiß ich nicht.", "refusal"),
    (DE, "Es tut mir leid, dabei kann ich Ihnen nicht helfen.", "refusal"), (FR, "Désolé, je ne suis pas en mesure de répondre.", "refusal"), (FR, "Je n'ai aucune information à ce sujet.", "refusal"),
    # Answers in another language.
    (EN, "Drücken Sie den Notrufknopf und warten Sie ruhig auf die Feuerwehr, die Türen dürfen nicht mit Gewalt geöffnet werden.", "language"),
    (EN, "Appuyez sur le bouton d'alarme et attendez les secours sans forcer les portes.", "language"), (EN, "Prema o botão de alarme e espere pela ajuda sem forçar as portas.", "language"),
    (EN, "Premi il pulsante di allarme e aspetta i soccorsi, non forzare le porte della cabina.", "language"), (EN, "Druk op de alarmknop en wacht op hulp, want het is niet veilig om de deuren te openen.", "language"),
    (EN, "Naciśnij przycisk alarmowy i czekaj na pomoc, nie otwieraj drzwi na siłę.", "language"), (EN, "Alarm düğmesine basın ve yardım gelene kadar bekleyin, kapıları zorlamak için bir şey kullanmayın.", "language"),
    (EN, "Нажмите кнопку вызова и ждите спасателей, не открывайте двери силой.", "language"), (EN, "비상 호출 버튼을 누르고 구조를 기다립니다.", "language"),
    (KO, "Нажмите кнопку вызова и ждите спасателей.", "language"), (KO, "Tryck på larmknappen och vänta på hjälp.", "language"), (DE, "Press the alarm button and wait for help without forcing the doors.", "language"),
    (FR, "Press the alarm button and wait for help without forcing the doors.", "language"), (FR, "Pulse el botón de alarma y espere la ayuda sin forzar las puertas de la cabina.", "language"),
    # The question again.
    (KO, "정전이 되면 승강기에 갇힌 사람은 무엇을 하여야 하는가?", "copy"), (EN, "What should people stuck in a lift do when the power fails?", "copy"),
    # Lost ends and open marks.
    (KO, "비상 호출 버튼을 누른 다음 문을 억지로 열지 말고 구조대가 올 때까지 기", "truncated"), (EN, "Press the alarm button, stay calm and wait for the", "truncated"), (EN, "Press the button (the red one next to the door and wait for help in the cabin of the lift.", "truncated"),
    (EN, "Say \"help and wait.", "truncated"), (EN, "Press the <b>alarm button and wait.", "truncated"), (EN, "The load is $$m g and nothing more.", "truncated"),
    # Nothing at all.
    (KO, "Fatal: worker ran out of memory while decoding " + "a batch of requests " * 12, "empty"), (EN, "HTTP 503 Service Unavailable", "empty"), (EN, "-- --", "empty"),
    # Sound answers.
    (KO, "비상 호출 버튼을 누르고 구조를 기다립니다.", None), (KO, "문을 억지로 열 수 없으므로 구조대를 기다려야 합니다.", None), (KO, "호출 버튼(빨간색)을 누르고 \"대기 중\" 표시를 확인합니다.", None),
    (KO, "1) 호출 버튼을 누름\n2) 구조를 기다림", None), (EN, "Press the alarm button and wait; people cannot open the doors from inside.", None), (EN, "Nobody can answer for your safety if you force the doors, so wait.", None),
    (EN, "Call the operator, who will tell you what is known and when help arrives.", None), (DE, "Drücken Sie den Notrufknopf und warten Sie auf Hilfe.", None), (DE, "Die Türen lassen sich nicht öffnen, warten Sie deshalb auf die Feuerwehr.", None),
    (FR, "Appuyez sur le bouton d'alarme et attendez les secours.", None), (FR, "Ne forcez pas les portes, les secours ne peuvent pas entrer autrement.", None), (EN, "Press <b>alarm</b> and wait (help comes in 30 minutes).", None),
    (EN, "People trapped in a lift when the power fails should press the alarm button and wait.", None), (KO, "정전이 되면 승강기에 갇힌 사람은 호출 버튼을 누르고 기다려야 한다.", None),
]


def measured() -> tuple[float, float, list]:
    """Precision and recall of the first defect, and the cases that are wrong."""
    found = [(q, a, kind, (defects(q, a) or [None])[0]) for q, a, kind in HELD_OUT]
    right = sum(kind is not None and kind == first for _, _, kind, first in found)
    return right / sum(f is not None for *_, f in found), right / sum(k is not None for _, _, k, _ in found), [x for x in found if x[2] != x[3]]


def test_held_out_answers():
    precision, recall, _ = measured()
    assert precision >= 0.85 and recall >= 0.8
