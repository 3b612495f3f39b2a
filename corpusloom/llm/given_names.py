"""Given names that show a person where no title does; apart from the pool of replacements.

Names that are also everyday words or months (Will, Mark, Rose, Grace, May, April) are left out.
"""

from __future__ import annotations

import re

LATIN_M = """Aaron Adam Adrian Alan Albert Alejandro Alessandro Alex Alexander Alexandre Alfred Ali Andrea Andreas Andrew Andrzej Anthony Antoine Antonio Arthur
Benjamin Bernard Bernd Brandon Brian Bruno Bryan Carl Carlos Charles Christian Christopher Claude Colin Craig Daniel David Dennis Diego Dieter Dirk Donald Douglas Dylan
Edward Emil Enrique Eric Erik Ethan Eugene Felix Fernando Francesco Francisco Frank Franz François Fritz Gabriel Gary Georg George Gerald Gerhard Giovanni Giuseppe Gregory Guillaume Günter
Hans Harald Harold Harry Heinrich Heinz Helmut Henri Henry Hermann Horst Howard Hugo Ian Ivan Jacob Jacques Jakob James Jan Jason Javier Jean Jeffrey Jens Jeremy Jerry Jesús Joachim Johann Johannes John Jonas Jonathan Jorge Joseph José Joshua Juan Julien Jürgen Justin
Karl Keith Kenneth Kevin Klaus Kurt Kyle Larry Lars Laurent Lawrence Leon Louis Luca Lucas Luis Lukas Manfred Manuel Marcel Marco Mario Markus Martin Matteo Matthew Matthias Maximilian Michael Michel Miguel Mohamed Muhammad
Nathan Nicholas Nicolas Noah Olaf Oliver Oscar Otto Pablo Pascal Patrick Paul Pedro Peter Philip Philippe Pierre Piotr Rafael Ralf Ralph Raymond René Ricardo Richard Robert Roberto Roger Roland Ronald Rudolf Russell Ryan
Samuel Scott Sean Sebastian Sergio Simon Stefan Stephen Steven Sven Theodore Thomas Tim Timothy Tobias Tom Tyler Udo Ulrich Uwe Victor Vincent Volker Walter Werner Wilhelm William Wolfgang Zachary"""
LATIN_F = """Abigail Agnes Alexandra Alice Alicia Alma Amanda Amélie Amy Ana Andrea Angela Anita Anke Ann Anna Anne Annette Ashley Astrid Barbara Beatrice Bianca Birgit Brenda Brigitte Camille Carla Carmen Carol Caroline Catherine Cecilia Chantal Charlotte Chloe Christina Christine Clara Claudia Cristina Cynthia
Deborah Denise Diana Diane Donna Doris Dorothy Edith Eleanor Elena Elisabeth Elizabeth Elke Ella Emily Emma Erika Esther Eva Fatima Fiona Frances Franziska Françoise Freya Gabriele Gisela Gloria Hannah Heather Heidi Heike Helen Helena Helga Ilse Inge Ingrid Irene Isabel Isabella
Jana Jane Janet Jean Jennifer Jessica Joan Johanna Juana Judith Julia Julie Karen Karin Katharina Katherine Kathleen Kelly Kimberly Kristin Laura Lauren Lena Linda Lisa Louise Lucia Lucy Luisa Magdalena Manon Manuela Margaret Margarita Maria Marie Marion Marta Martha Martina Mary María Megan Melanie Melissa Michelle Monica Monika
Nadia Nancy Natalia Natalie Nicole Nina Nora Olivia Pamela Patricia Paula Petra Pilar Rachel Rebecca Renate Rita Rosa Ruth Sabine Samantha Sandra Sara Sarah Shirley Silvia Sofia Sophia Sophie Stefanie Stephanie Susan Susanne Sylvie Tanja Teresa Theresa Ursula Ute Valentina Vanessa Vera Veronica Victoria Virginia Yvonne Zoe"""
CYRILLIC_M = """Александр Алексей Анатолий Андрей Антон Артём Борис Вадим Валерий Василий Виктор Виталий Владимир Вячеслав Геннадий Георгий Глеб Григорий Даниил Денис Дмитрий Евгений Егор Иван Игорь Илья Кирилл Константин Лев Леонид Максим Михаил Никита Николай Олег Павел Пётр Роман Руслан Сергей Станислав Степан Тимофей Фёдор Юрий Яков Ярослав"""
CYRILLIC_F = """Алла Александра Алина Алёна Анастасия Анна Валентина Валерия Варвара Вера Виктория Галина Дарья Евгения Екатерина Елена Елизавета Жанна Зинаида Инна Ирина Кристина Ксения Лариса Лидия Любовь Людмила Марина Мария Надежда Наталья Нина Оксана Ольга Полина Раиса Светлана София Тамара Татьяна Ульяна Юлия Яна"""
KNOWN = {"m": [*LATIN_M.split(), *CYRILLIC_M.split()], "f": [*LATIN_F.split(), *CYRILLIC_F.split()]}


def one_of(words: list[str]) -> str:
    """A regular expression of ``words`` as a tree of letters, so that most texts fail at the first."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def text(node: dict) -> str:
        ways = [re.escape(c) + text(x) for c, x in sorted(node.items()) if c]
        if not ways:
            return ""
        return f"(?:{'|'.join(ways)}){'?' if '' in node else ''}"

    return text(tree)
