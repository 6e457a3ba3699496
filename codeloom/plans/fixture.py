"""A small Java repository that the queries of the parser and the resolver run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.sources.files import parse_files

FILES = {
    "zoo/Animal.java": """package zoo;
public interface Animal {
  String name();
  default int legs() { return 4; }
}
""",
    "zoo/Base.java": """package zoo;
import java.util.List;
@Service("base")
public abstract class Base<T> implements Animal {
  protected Feeder feeder;
  private final List<Base> kin = null;
  Base(Feeder feeder) { this.feeder = feeder; }
  public String name() { return label(); }
  String label() { return "base"; }
  public abstract void eat(Food food);
  enum Mood { CALM, WILD }
}
""",
    "zoo/Lion.java": """package zoo;
import kitchen.Food;
import static kitchen.Tools.weigh;
import static kitchen.Oven.*;
public class Lion extends Base<Food> {
  Lion(Feeder f) { super(f); }
  @Override
  public void eat(Food food) { feed(feeder, food); }
  void feed(Feeder feeder, Food food) {
    feeder.serve(food, 3);
    feeder.serve(food, 3L);
    feeder.serve((Object) food);
    feeder.serve(null);
    feeder.serve(name());
    feeder.serve(new Soup());
    super.name();
    legs();
    weigh(food);
    heat(food);
    hum();
    both();
    new Cub(2).play();
    lost.call();
  }
  static class Cub extends Lion {
    Cub(int age) { super(null); }
    void play() { this.eat(null); }
  }
}
""",
    "zoo/Feeder.java": """package zoo;
import kitchen.*;
public class Feeder {
  public void serve(Food food, long count) {}
  public void serve(Food food, int count) {}
  public void serve(Food food) {}
  public void serve(Object thing) {}
  public void serve(String text) {}
}
""",
    "kitchen/Food.java": """package kitchen;
public class Food {
  public int size(int[] parts, java.util.Map<String, Food> more) { return 1; }
}
""",
    "kitchen/Soup.java": "package kitchen;\n@Deprecated\npublic class Soup extends Food {}\n",
    "kitchen/Tools.java": "package kitchen;\npublic class Tools {\n  public static int weigh(Food f) { return 1; }\n}\n",
    "kitchen/Oven.java": "package kitchen;\npublic class Oven {\n  public static void heat(Food f) {}\n}\n",
    "park/Guide.java": """package park;
import zoo.Lion;
@RestController
public class Guide {
  @GetMapping("/tour")
  void tour(Lion l, Radio r) throws Lost {
    l.eat(null);
    r.hum();
  }
}
""",
    "park/Radio.java": "package park;\nclass Radio {\n  void hum() {}\n  void both() {}\n}\n",
    "park/Horn.java": "package park;\nclass Horn {\n  void both() {}\n}\n",
    "park/Broken.java": "package park;\nclass Broken {\n  void half( {\n",
}


def parsed(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(f, bytearray(t.encode())) for f, t in FILES.items()], "file string, content binary")
    return parse_files(rows)
