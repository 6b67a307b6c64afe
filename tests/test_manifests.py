"""Solution folders and package versions on hand-made files."""

from graphloom.sources import manifests as M

FOLDER = "2150E333-8FDC-42A3-9474-1A3956D46DE8"
SLN = f'''Microsoft Visual Studio Solution File
Project("{{{FOLDER}}}") = "API", "API", "{{A1}}"
EndProject
Project("{{{FOLDER.lower()}}}") = "Public", "Public", "{{A2}}"
EndProject
Project("{{FAE0}}") = "Web", "src\\Web\\Web.csproj", "{{b1}}"
EndProject
Project("{{FAE0}}") = "Core", "src\\Core\\Core.csproj", "{{B2}}"
EndProject
Project("{{FAE0}}") = "Odd", "Odd.csproj", "{{B3}}"
EndProject
Project("{{{FOLDER}}}") = "X", "X", "{{C1}}"
EndProject
Project("{{{FOLDER}}}") = "Y", "Y", "{{C2}}"
EndProject
Project("{{FAE0}}") = "Loop", "Loop.csproj", "{{C3}}"
EndProject
Global
  GlobalSection(NestedProjects) = preSolution
    {{B1}} = {{A2}}
    {{a2}} = {{A1}}
    {{B3}} = {{B2}}
    {{C3}} = {{C1}}
    {{C1}} = {{C2}}
    {{C2}} = {{C1}}
  EndGlobalSection
EndGlobal
'''
SLNX = '<Solution><Folder Name="/API/"><Folder Name="Public"><Project Path="src\\Web\\Web.csproj" /></Folder><Project Path="a.csproj"><Build /></Project></Folder><Project Path="top.csproj"/><Project/></Solution>'


def test_solution_folders(spark):
    files = spark.createDataFrame([("a.sln", SLN), ("b/b.slnx", SLNX), ("bad.slnx", "<Solution><Project Path='x'>"), ("empty.sln", ""), ("none.sln", None), ("c.txt", SLN)], "file string, text string")
    got = {(r.file, r.path): r.folder for r in M.solution_folders(files).collect()}
    assert got == {
        ("a.sln", "src/Web/Web.csproj"): "API/Public", ("a.sln", "src/Core/Core.csproj"): "", ("a.sln", "Odd.csproj"): "", ("a.sln", "Loop.csproj"): None,
        ("b/b.slnx", "src/Web/Web.csproj"): "API/Public", ("b/b.slnx", "a.csproj"): "API", ("b/b.slnx", "top.csproj"): "",
    }


def test_nuget_references(spark):
    ref = lambda n, **a: f'<PackageReference Include="{n}" ' + " ".join(f'{k}="{v}"' for k, v in a.items()) + "/>"
    project = lambda *x: "<Project>\n<ItemGroup>\n" + "\n".join(x) + "\n</ItemGroup>\n</Project>"
    on = "<PropertyGroup><ManagePackageVersionsCentrally>{}</ManagePackageVersionsCentrally></PropertyGroup>"
    props = project(on.format("false"), on.format(" TRUE "), '<PackageVersion Include="A" Version="1.0"/>', '<PackageVersion Include="a" Version="2.0"/>', '<PackageVersion Include="P" Version="$(PVersion)"/>', '<PackageVersion Include="N"/>')
    inner = project('<PackageVersion Include="A" Version="9.0"/>')
    files = [
        ("Directory.Packages.props", props), ("src/in/Directory.Packages.props", inner), ("src/in/sub/In.csproj", project(ref("A", Version="0.1"), ref("B"))),
        ("src/Web/Web.csproj", project(ref("A"), ref("a", VersionOverride="3.0"), ref("P"), ref("N"), ref("Missing"), '<PackageReference Include="A">\n<VersionOverride>$(X)</VersionOverride></PackageReference>')),
        ("src/Own.csproj", project(on.format("false"), '<PackageReference Include="A">\n<Version> 1.2.* </Version>\n</PackageReference>', ref("C", Version="$(C)"))),
        ("Bad.csproj", "<Project>"), ("Null.csproj", None), ("lib/Lib.csproj", project(on.format("true"), ref("A"))),
    ]
    got = [tuple(r) for r in M.nuget_references(spark.createDataFrame(files, "file string, text string")).where("project <> 'lib/Lib.csproj'").collect()]
    central = "Directory.Packages.props"
    prop = "version comes from an MSBuild property ({})".format
    want = [
        ("src/Own.csproj", "A", "1.2.*", "src/Own.csproj", 4, False, None), ("src/Own.csproj", "C", None, "src/Own.csproj", 7, False, prop("$(C)")),
        ("src/Web/Web.csproj", "A", None, "src/Web/Web.csproj", 8, True, prop("$(X)")), ("src/Web/Web.csproj", "A", "2.0", central, 6, True, None),
        ("src/Web/Web.csproj", "Missing", None, "src/Web/Web.csproj", 7, True, f"centrally managed, but no PackageVersion in {central}"),
        ("src/Web/Web.csproj", "N", None, central, 8, True, "no version declared"), ("src/Web/Web.csproj", "P", None, central, 7, True, prop("$(PVersion)")),
        ("src/Web/Web.csproj", "a", "3.0", "src/Web/Web.csproj", 4, True, None),
        ("src/in/sub/In.csproj", "A", "0.1", "src/in/sub/In.csproj", 3, False, None), ("src/in/sub/In.csproj", "B", None, "src/in/sub/In.csproj", 4, False, "no version declared"),
    ]
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(got, key=key) == sorted(want, key=key)
    lone = M.nuget_references(spark.createDataFrame([f for f in files if f[0].startswith("lib")], "file string, text string")).collect()
    assert [(r.version, r.problem) for r in lone] == [(None, "centrally managed, but no PackageVersion in a Directory.Packages.props")]


def test_same_origin(spark):
    from pyspark.sql import functions as F

    from graphloom.functions import scalars as S

    base = ("https://dev.example.com/org", "My Project", "azure-devops")
    rows = [
        (*base, "https://dev.example.com/org/My%20Project/_git/x", True), (*base, "HTTPS://DEV.example.com:443/ORG/my%20project/_git/x", True), (*base, "https://dev.example.com/org/my%20project", True),
        (*base, "http://dev.example.com/org/My%20Project/_git/x", False), (*base, "https://dev.example.com:8443/org/My%20Project", False), (*base, "https://me@dev.example.com/org/My%20Project", False),
        (*base, "https://dev.example.com/org2/My%20Project", False), (*base, "https://dev.example.com/org/Other", False), (*base, "not a url", False), (*base, None, False),
        ("https://dev.example.com/org", "a+b", "azure-devops", "https://dev.example.com/org/a+b/_git/x", True), ("https://dev.example.com/", "P", "azure-devops", "https://dev.example.com/P", True), ("https://dev.example.com/org", "P", "github", "https://dev.example.com/org/P", False),
    ]
    df = spark.createDataFrame(rows, "source string, project string, provider string, repository string, want boolean")
    bad = df.withColumn("got", S.same_origin(*[F.col(c) for c in ("source", "project", "provider", "repository")])).where("got <> want").collect()
    assert bad == []
