"""Labelled pages for the markup model.

PAGES: the families a line holds, and the line, all of whose signs of these families are markup. MIXED: lines with
markup and ordinary signs, where each stretch of markup is set in brackets with its family.
"""

H, M, W, L, N = ("html",), ("markdown",), ("wiki",), ("latex",), ()
PAGES: list[tuple[tuple[str, ...], str]] = [
    (H, "The <b>bridge</b> was built in 1920."), (H, "We met <em class=\"x\">Anna</em> there<br/>."), (H, "<h2>Opening hours</h2>"), (H, "See <a href=\"/x/y.html\">the page</a> first."),
    (H, "Fish &amp; chips are sold here."), (H, "It was &ldquo;late&rdquo; again."), (H, "A line&#8212;done."), (H, "It is&#x27;s own."), (H, "The end</p>."), (H, "An open cell<td>."),
    (H, "A hidden note<!-- look -->."), (H, "<!-- all of it"), (H, "left over -->."), (H, "Tags such as &lt;id&gt; count."), (H, "A <img src='b.png' alt=\"\"> here."), (H, "<script>run(2)</script> stays."),
    (H, "<span style='color:#123'>Red</span> words."), (H, "Chapter <small>v3</small>"), (H, "<a id='q'></a>Start"), (H, "A break<BR>."), (H, "<STRONG>Loud</STRONG> words."), (H, "All&nbsp;in&nbsp;one."), (H, "<p class=\"lead\">Text"), (H, "<code>ls</code> lists files."), (H, "H<sub>2</sub>O and <i>more</i>."), (H, "A <style>p{}</style> rule."), (H, "word</b> here"), (H, "<td colspan=\"2\">cell</td>"), (H, "5 &gt; 3 &lt; 9"),
    (M, "The **bridge** was built."), (M, "The *bridge* was built."), (M, "A ***very*** old one."), (M, "An __old__ one."), (M, "An _old_ one."), (M, "Use `run --fast` now."), (M, "Use `` a `b` `` now."), (M, "It is ~~gone~~ now."), (M, "See [the page](a/b.md) first."),
    (M, "See [the page][ref-3] first."), (M, "See [home][]."), (M, "Look ![plan](i/p.png)."), (M, "Look ![][fig-2]."), (M, "As said[^3]."), (M, "[^7]: The note itself."), (M, "A \\*star\\* stays."), (M, "* First of all, the bridge."), (M, "- Then the road."), (M, "+ Then the river."), (M, "1. Count the boats."), (M, "2) Count again."),
    (M, "> She said so."), (M, ">> She said so too."), (M, "| a | b | c |"), (M, "| The last cell is open."), (M, "## Opening hours"), (M, "#### The road was long."), (M, "- [ ] Paint the door."), (M, "- [x] Paint the wall."), (M, "- [X] Paint the gate."), (M, "**(new)**"), (M, "**Anna"), (M, "Inc.** and more"), (M, "`Anna"), (M, "Prof.` came"), (M, "*Dr"), (M, "The end.*"), (M, "__Anna"), (M, "~~Dr"), (M, "_Dr"), (M, "\\_not\\_ here"), (M, "[Road notes](top.md)"), (M, "*Road notes*"), (M, "```python"), (M, "<https://a.example/x>"), (M, "They kept the __token__."), (M, "Near the closed __gate__."), (M, "__gate__, then"), (M, "_Anna and"), (M, "古い__橋__です。"), (M, "古い**橋**です。"), (M, "`古い`橋です。"), (M, "橋[新](a/b.md)です。"), (M, "橋[新][ref-2]です。"), (M, "12行***橋***です。"), (M, "A \\# sign"), (M, "a \\[b\\] c"),
    (W, "The [[bridge]] was built."), (W, "The [[Main page|bridge]] was built."), (W, "Built late {{cn}}."), (W, "Built{{citation needed|date=June}}."), (W, "{{small|Anna}} built it."), (W, "{{as of|2011}} it stands."), (W, "A ''thin'' line."), (W, "A '''thick''' line."), (W, "A '''''thick thin''''' line."), (W, "== Opening hours =="), (W, "=== Opening hours ==="), (W, "==== Road 3 ===="), (W, "[[Category:Roads]]"), (W, "[[File:a.png|thumb]]"), (W, "See [http://a.example the page]."), (W, "{{Infobox road|name=y."), (W, "[[Talk:Road#Old|talk]]"), (W, "[[Anna"), (W, "Ltd]] built it"), (W, "{{small|Dr"), (W, "Ltd}} built it"), (W, "'''Anna"), (W, "Ltd''' built it"), (W, "Ltd'' built it"), (W, "''(so)''."), (W, "''Road notes''"), (W, "[[Road notes]]"), (W, "''Dr"), (W, "'''''Dr"), (W, "{| class=\"wikitable\""), (W, "古い[[橋]]です。"), (W, "{{cn}}。"), (W, "'''橋'''です。"),
    (L, "\\section{Opening hours}"), (L, "\\subsection{A road}"), (L, "The \\textbf{bridge} was built."), (L, "The \\emph{bridge}."), (L, "As in \\cite{key3}."), (L, "(Part~\\ref{sec:road})."), (L, "Here\\label{eq:b}."), (L, "So on \\ldots{}."), (L, "Here\\footnote{old}."), (L, "In 7\\,km."), (L, "Up 30\\%."), (L, "{\\it Old} bridge."), (L, "{\\bf Old} bridge."), (L, "For all $n$."), (L, "With $x_i = 2$ here."), (L, "With $n \\le k$ here."), (L, "So ($p \\ge 0.5$)."), (L, "Now \\(x_i < y\\)."), (L, "\\begin{itemize}\\item two\\end{itemize}."), (L, "Now \\[ a = b \\]."), (L, "$$ a = b $$"), (L, "With $\\sum_{i} w_i = 1$."), (L, "\\texttt{Anna"), (L, "Inc.} built it"), (L, "}"), (L, "Corp.} rose again"), (L, "S.A.}"), (L, "Ltd} met"), (L, "\\textsc{Anna} built."), (L, "R\\&D in use."), (L, "The \\textit{Dr"), (L, "{\\it Dr"), (L, "\\item First."), (L, "\\alpha and \\beta rays."), (L, "古い\\textbf{橋}です。"), (L, "古い{\\it 橋}です。"), (L, "\\texttt{橋}と川。"), (L, "$k$ boats"), (L, "\\documentclass{article}"),
    (N, "It costs $30 to $50 a day."), (N, "From $5.20 to $7 before."), (N, "If a < b and c > 0 then stop."), (N, "With x > 5 it fails."), (N, "A grid of 4 * 6 * 2 cells."), (N, "Made by the Q&A team."), (N, "Smith & Sons built it."), (N, "Near 2^8 bytes."), (N, "He wrote it so [sic]."), (N, "In arrays like b[4]."), (N, "In lists like a[3]."), (N, "With C# and F# code."), (N, "See issue #31."), (N, "About ~70 percent."), (N, "Both A | B tests pass."), (N, "As {new} or so."), (N, "In the max_size_of_set field."), (N, "Under D:\\files\\old."), (N, "Under C:\\data\\runs\\x."), (N, "The file a_b_c.txt is new."), (N, "Tom's and Ann's house."), (N, "It's 5' 10'' tall."), (N, "He said 'no' twice."), (N, "Rate = 5 and x = 3."), (N, "An e-mail - short - came."), (N, "In 2019. Then more."), (N, "snake_case names"), (N, "AT&T and R&D rose."), (N, "I&C Ltd and P&P S.A. agree."), (N, "5 > 3 and 2 < 4."), (N, "The set {a, b}."), (N, "(see note 4)."), (N, "Use __init__.py files."), (N, "Paths like /usr/bin/x."), (N, "A 50% rise; 3 + 4 = 7."), (N, "It is -5 degrees."), (N, "Take x[0] and y[12]."), (N, "The year [2019] was hot."), (N, "About ~5 km and ~7 km."), (N, "10^6 or 2^10 of them."), (N, "\\\\server\\share\\x"), (N, "$100 and $200."), (N, "#5 and #6 won."), (N, "a | b | c options"), (N, "value {x} in {y}"), (N, "橋は5 * 3 * 2です。"), (N, "橋 [sic]。"), (N, "Ann & Bob's."), (N, "a && b || c"), (N, "3 < 4"), (N, "<3 and :>"), (N, "file_name and other_name here"), (N, "under C:\\data\\runs。"), (N, "in the max_pairs_per_call field。"), (N, "as {draft}。"), (N, "2 * 3"),
]

MIXED = [
    "The fee is $5 and ⟦latex:$y^2$⟧ is given.", "From $7 to $9 for ⟦latex:$n$⟧ boats.", "With ⟦latex:$a_1$⟧ it is $30 a day.", "It costs $12 where ⟦latex:$k \\le 3$⟧ holds.",
    "If a < b then ⟦html:<b>⟧stop⟦html:</b>⟧.", "The R&D team ⟦html:&amp;⟧ others.", "When x > 2 ⟦html:<br>⟧go on.", "⟦html:<i>⟧AT&T⟦html:</i>⟧ built it.", "3 < 4 ⟦html:&lt;⟧ 5",
    "Read max_of_set in ⟦markdown:**bold**⟧ type.", "4 * 5 boats, ⟦markdown:*all*⟧ of them.", "The a_b_c file is ⟦markdown:_new_⟧.", "Call __init__ with ⟦markdown:`x`⟧.", "Call __init__ first.", "It has __main__ and __doc__ in it.", "Run m_a_x and __init__", "Let __name__ be.",
    "See b[3] in ⟦markdown:[the list](a.md)⟧.", "He said [sic] and ⟦markdown:**left**⟧.", "About ~5 ⟦markdown:~~or 6~~⟧ of them.", "Issue #4 is ⟦markdown:**done**⟧.", "⟦markdown:- ⟧A 2 * 3 board", "⟦markdown:## ⟧C# and F#", "⟦markdown:| a | ⟧⟦markdown:**b**⟧⟦markdown: |⟧",
    "The set {a, b} of ⟦wiki:[[boats]]⟧.", "It is 5' 10'' and ⟦wiki:''thin''⟧.", "Take b[4] from ⟦wiki:{{cn}}⟧ it.", "x = 3 in ⟦wiki:[[the mill|mill]]⟧.", "A | B of ⟦wiki:'''C'''⟧",
    "Under D:\\files\\new ⟦latex:\\emph{now}⟧.", "As {draft} in ⟦latex:\\textbf{bold}⟧.", "10^6 of ⟦latex:$10^6$⟧.", "The Q&A of ⟦latex:\\cite{a1}⟧.", "2 * 3 is ⟦latex:$x$⟧.",
]
